"""Splitting files into line-addressed chunks with symbols.

Plain text is packed by a fold in SQL functions.  Files with known syntax go through
``chunk_files``: Python by its own parser, other languages by the lexer and the stack of
``functions.lexing``.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import lexing

BUDGET, TINY = 3800, 40
PIECE = "struct<start_line:int,end_line:int,content:string>"
SYMBOL = "struct<kind:string,name:string,line:int>"
CHUNK_SCHEMA = f"path string, ordinal int, start_line int, end_line int, language string, symbols array<{SYMBOL}>, content string"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def pack_lines(content: Column, budget: int = BUDGET) -> Column:
    """Pieces of whole lines: a piece ends before the line that comes once it is over the budget.

    Stripped, blank ones left out; a piece of more than twice the budget is cut into windows."""
    start = F.expr(f"named_struct('out', cast(array() as array<{PIECE}>), 'buf', cast(array() as array<string>), 'size', 0, 'first', 1, 'at', 1)")

    def piece(a: Column) -> Column:
        return F.array(F.struct(a["first"].alias("start_line"), (a["first"] + F.size(a["buf"]) - 1).alias("end_line"), F.array_join(a["buf"], "\n").alias("content")))

    def step(a: Column, line: Column) -> Column:
        full = a["size"] > budget
        return F.struct(
            F.when(full, F.concat(a["out"], piece(a))).otherwise(a["out"]).alias("out"),
            F.when(full, F.array(line)).otherwise(F.concat(a["buf"], F.array(line))).alias("buf"),
            (F.when(full, 0).otherwise(a["size"]) + F.length(line) + 1).cast("int").alias("size"),
            F.when(full, a["at"]).otherwise(a["first"]).cast("int").alias("first"),
            (a["at"] + 1).cast("int").alias("at"),
        )

    pieces = F.aggregate(F.split(content, "\n"), start, step, lambda a: F.concat(a["out"], piece(a)))
    whole = F.filter(F.transform(pieces, lambda p: p.withField("content", stripped(p["content"]))), lambda p: p["content"] != "")
    return F.flatten(F.transform(whole, lambda p: F.when(F.length(p["content"]) <= 2 * budget, F.array(p)).otherwise(_windows(p, budget))))


def _windows(p: Column, budget: int) -> Column:
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    at = F.sequence(F.lit(0), F.length(p["content"]) - 1, F.lit(budget))
    return F.transform(
        at,
        lambda k: F.struct(
            (p["start_line"] + breaks(F.substring(p["content"], F.lit(1), k))).cast("int").alias("start_line"),
            (p["start_line"] + breaks(F.substring(p["content"], F.lit(1), k + budget))).cast("int").alias("end_line"),
            F.substring(p["content"], k + 1, F.lit(budget)).alias("content"),
        ),
    )


def merge_tiny(sizes: Column, least: int = TINY) -> Column:
    """Group number of each segment: the buffer and the next merge when either is below ``least``."""
    start = F.expr("named_struct('out', cast(array() as array<int>), 'size', -1L, 'group', 0)")

    def step(a: Column, size: Column) -> Column:
        first = a["size"] < 0
        joins = ~first & ((a["size"] < least) | (size < least))
        group = a["group"] + F.when(joins, 0).otherwise(1)
        return F.struct(F.concat(a["out"], F.array(group.cast("int"))).alias("out"), F.when(joins, a["size"] + size).otherwise(size).cast("long").alias("size"), group.cast("int").alias("group"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])


def chunk_id(path: Column, start: Column, end: Column, ordinal: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x01", path, start, end, ordinal, F.sha2(content, 256)), 256), 1, 32)


def symbols_in(symbols: Column, start: Column, end: Column) -> Column:
    """Those whose line lies within."""
    return F.filter(symbols, lambda s: s["line"].between(start, end))


# ---- syntax -------------------------------------------------------------------------------------

def python_symbols(code: str | ast.Module) -> list[tuple[str, str, int]]:
    found = set()

    def walk(node: ast.AST, inside: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                found.add(("class", child.name, child.lineno))
                walk(child, True)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                found.add(("method" if inside else "function", child.name, child.lineno))
                walk(child, False)
            elif not isinstance(child, ast.expr):  # no statement stands below an expression
                walk(child, inside)

    walk(ast.parse(code) if isinstance(code, str) else code, False)
    return sorted(found, key=lambda s: (s[2], s[1]))


def python_starts(code: str | ast.Module) -> list[int]:
    body = (ast.parse(code) if isinstance(code, str) else code).body
    return [min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) for n in body]


#: Languages without a family whose declarations are lines of their own.
_LINES = {"markdown": ("heading", re.compile(r"#{1,6}\s+(.+)")), "make": ("rule", re.compile(r"([A-Za-z_][\w./-]*)\s*::?(?!=)"))}


def structure(code: str, language: str) -> tuple[list[int] | None, list[tuple[str, str, int]], set[int]]:
    """Starting lines of the top-level parts (None: not known), symbols, and lines of comments."""
    if language in _LINES:
        kind, pattern = _LINES[language]
        return None, [(kind, m[1].strip()[:200], i) for i, line in enumerate(code.split("\n"), 1) if (m := pattern.match(line))], set()
    if language == "python":
        try:
            remarks = {i for i, line in enumerate(code.split("\n"), 1) if line.lstrip().startswith("#")}
            tree = ast.parse(code)
            return python_starts(tree), python_symbols(tree), remarks
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass  # another version's syntax; its tokens and indentation will do
    if language in lexing.LANGUAGES:
        return lexing.outline(code, language)
    return None, [], set()


def extract_symbols(code: str, language: str | None) -> list[tuple[str, str, int]]:
    return structure(code, language)[1] if language else []


def segments(code: str, starts: list[int] | None, remarks: set[int]) -> list[tuple[int, int]] | None:
    """Line ranges (from 1) of the top-level parts; None where the structure is not known."""
    if not starts:
        return None
    # what stands before the first part, and comments between parts, go with the part that follows
    cuts: list[int] = []
    for k, s in enumerate(dict.fromkeys(starts)):
        low = (cuts[-1] if cuts else 0) + 1
        while k and s - 1 >= low and s - 1 in remarks:
            s -= 1
        cuts.append(1 if k == 0 else s)
    cuts = sorted(set(cuts))
    return [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], code.count("\n") + 2], strict=True)]


def pack(lines: list[str], first: int, budget: int = BUDGET) -> Iterator[tuple[int, int, str]]:
    """``pack_lines`` for one part of a file."""
    buf: list[str] = []
    size, start = 0, first
    groups = []
    for i, line in enumerate(lines):
        if size > budget:
            groups.append((start, buf))
            buf, size, start = [], 0, first + i
        buf.append(line)
        size += len(line) + 1
    groups.append((start, buf))
    for start, buf in groups:
        content = "\n".join(buf).strip()
        if len(content) > 2 * budget:
            for k in range(0, len(content), budget):
                yield start + content[:k].count("\n"), start + content[: k + budget].count("\n"), content[k : k + budget]
        elif content:
            yield start, start + len(buf) - 1, content


def chunk_file(code: str, language: str | None) -> list[tuple[int, int, str, list[tuple[str, str, int]]]]:
    """``start, end, content, symbols``; a file of unknown language has no chunks."""
    if language is None:
        return []
    starts, symbols, remarks = structure(code, language)
    lines, parts = code.split("\n"), segments(code, starts, remarks)
    out = []
    if parts is None:
        return [(a, b, text, symbols) for a, b, text in pack(lines, 1)]
    size = lambda a, b: len("\n".join(lines[a - 1 : b]).encode())
    merged = [parts[0]]
    for a, b in parts[1:]:
        if size(*merged[-1]) < TINY or size(a, b) < TINY:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    for a, b in merged:
        own = [s for s in symbols if a <= s[2] <= b]
        text = "\n".join(lines[a - 1 : b])
        if len(text.encode()) > BUDGET:
            out += [(x, y, t, own) for x, y, t in pack(lines[a - 1 : b], a)]
        elif text.strip():
            out.append((a, b, text.strip(), own))
    return out


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of ``path, language, content`` with deterministic ids."""

    text, symbol = pa.string(), pa.struct([("kind", pa.string()), ("name", pa.string()), ("line", pa.int32())])
    kinds = {"path": text, "ordinal": pa.int32(), "start_line": pa.int32(), "end_line": pa.int32(), "language": text, "symbols": pa.list_(symbol), "content": text}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(path, k, a, b, language, symbols, part) for k, (a, b, part, symbols) in enumerate(chunk_file(content or "", language))]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], list(kinds))

    chunks = files.select("path", "language", "content").mapInArrow(run, CHUNK_SCHEMA)
    key = chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("ordinal"), F.col("content"))
    return chunks.withColumn("chunk_id", key).withColumn("token_est", F.greatest(F.lit(1), F.floor(F.length("content") / 4)).cast("int"))


def hashed_vector(text: str, size: int) -> list[float]:
    """Signed feature hashing of words and letter triples, of length 1."""
    v = [0.0] * size
    for w in re.findall(r"[^\W_]+", text.lower()):
        for f, weight in [(w, 1.0), *((w[i : i + 3], 0.4) for i in range(len(w) - 2))]:
            h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little")
            v[h % size] += weight if h >> 63 else -weight
    norm = sum(x * x for x in v) ** 0.5
    return [x / norm for x in v] if norm else v
