"""Column functions over paths, files and queries."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension and by file name.
LANGUAGES = {
    "python": ["py"], "javascript": ["js", "jsx", "mjs", "cjs"], "typescript": ["ts", "mts"], "tsx": ["tsx"], "go": ["go"], "rust": ["rs"], "java": ["java"], "kotlin": ["kt", "kts"], "ruby": ["rb"], "php": ["php"],
    "c": ["c", "h"], "cpp": ["cpp", "cc", "hpp"], "csharp": ["cs"], "swift": ["swift"], "objc": ["m", "mm"], "scala": ["scala"], "bash": ["sh", "bash", "zsh"], "lua": ["lua"], "perl": ["pl"], "r": ["r"], "julia": ["jl"],
    "elixir": ["ex", "exs"], "erlang": ["erl"], "haskell": ["hs"], "ocaml": ["ml"], "clojure": ["clj"], "dart": ["dart"], "zig": ["zig"], "nim": ["nim"], "verilog": ["v", "sv"], "sql": ["sql"], "proto": ["proto"], "graphql": ["graphql"],
    "vue": ["vue"], "svelte": ["svelte"], "html": ["html"], "css": ["css"], "scss": ["scss"], "less": ["less"], "markdown": ["md"], "json": ["json"], "yaml": ["yaml", "yml"], "toml": ["toml"], "hcl": ["tf"], "dockerfile": ["dockerfile"],
    "cmake": ["cmake"], "make": ["makefile"],
}
NAMES = {"dockerfile": "dockerfile", "makefile": "make", "gnumakefile": "make", "cmakelists.txt": "cmake", "justfile": "make"}
#: A path in brackets, then a colon, L and a line number: the path starts with no colon and holds
#: neither a closing bracket nor a line end.
CITED_PATH = r"[^:\]\n][^\]\n]*?"
CITATION = rf"\[({CITED_PATH}):L(\d+)\]"
TOKEN = r"([\p{L}\p{N}]+)"


def _folds() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and their plain letters, by Unicode's decompositions."""
    found = {}
    for code in range(0xC0, 0x1F00):
        plain = unicodedata.normalize("NFD", chr(code))
        if plain[0].isascii() and plain[0].islower() and len(plain) > 1 and all(map(unicodedata.combining, plain[1:])):
            found[chr(code)] = plain[0]
    return "".join(found), "".join(found.values())


FOLDED = _folds()


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """``.`` for a file at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    name = basename(path)
    return F.lower(F.when(name.rlike(r"^.+\.[^.]+$"), F.substring_index(name, ".", -1)).otherwise(F.lit("")))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def language(path: Column) -> Column:
    """By file name, then by extension; null if unknown."""
    by_name = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    by_end = F.create_map(*(F.lit(x) for lang, ends in LANGUAGES.items() for e in ends for x in (e, lang)))
    return F.coalesce(F.try_element_at(by_name, F.lower(basename(path))), F.try_element_at(by_end, extension(path)))


def lines_of_code(content: Column) -> Column:
    """Line feeds plus one."""
    return (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast("long")


def token_estimate(content: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(content) / 4)).cast("long")


def looks_binary(content: Column) -> Column:
    """A NUL, or no valid UTF-8, within the first 8000 bytes."""
    head = F.substring(content, 1, 8000)
    return (F.instr(F.decode(head, "ISO-8859-1"), "\0") > 0) | ~F.is_valid_utf8(head.cast("string"))


def analyze(text: Column) -> Column:
    """Terms as they are written: runs of letters and digits, lower-case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def joined_terms(text: Column) -> Column:
    """``analyze`` as one string: a blank before, between and after the terms."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def folded(text: Column) -> Column:
    """Without diacritics: Latin letters that Unicode takes apart into a letter and marks."""
    return F.translate(text, *FOLDED)


def index_terms(text: Column) -> Column:
    """Terms of the full-text index before stemming: diacritics are folded first."""
    return analyze(folded(F.lower(text)))


def fts_query(query: Column) -> Column:
    """The full-text form of a free-text query: its phrase, then its terms, 12 at most."""
    words = F.filter(F.split(F.regexp_replace(query, r"(?U)[^\w\s.]", " "), r"(?U)\s+"), lambda w: F.length(w) >= 2)
    quoted = F.concat(F.lit('"'), F.array_join(words, " "), F.lit('"'))
    return F.array_join(F.slice(F.when(F.size(words) > 1, F.concat(F.array(quoted), words)).otherwise(words), 1, 12), " OR ")


def symbol_query_terms(query: Column) -> Column:
    """Lower-case blank-separated words of three letters and more, parentheses as blanks."""
    return F.filter(F.split(F.lower(F.translate(query, "()", "  ")), r"\s+"), lambda w: F.length(w) >= 3)


def snippet(content: Column, width: int = 110) -> Column:
    return F.substring(F.array_join(F.slice(F.split(content, "\n"), 1, 2), " "), 1, width)


def file_window(content: Column, start: Column, end: Column | None, most: int | None = None) -> Column:
    """Lines ``start..end`` (from 1) and where they lie: ``start, end, total, content``."""
    lines = F.split(content, "\n")
    total = F.size(lines)
    first = F.greatest(F.lit(1), start)
    last = F.least(total, F.coalesce(end, total) if end is not None else total)
    if most is not None:
        last = F.least(last, first + most)
    return F.struct(first.cast("long").alias("start"), last.cast("long").alias("end"), total.cast("long").alias("total"), F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n").alias("content"))


def citations(text: Column) -> Column:
    """Distinct ``path, line`` in the order they first occur."""
    paths, numbers = (F.regexp_extract_all(text, F.lit(CITATION), F.lit(k)) for k in (1, 2))
    return F.array_distinct(F.filter(F.zip_with(paths, numbers, lambda p, n: F.struct(F.trim(p).alias("path"), n.cast("long").alias("line"))), lambda c: c["path"] != ""))


def demote(text: Column, valid: Column) -> Column:
    """``[path:Ln]`` becomes ``[path]`` where ``path`` is not among ``valid``."""
    whole = F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)))
    path = lambda c: F.trim(F.regexp_extract(c, CITATION, 1))
    return F.aggregate(F.filter(whole, lambda c: ~F.array_contains(valid, path(c))), text, lambda t, c: F.replace(t, c, F.concat(F.lit("["), path(c), F.lit("]"))))


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[^\w.-]+", "-")


def embed_text(path: Column, names: Column, content: Column) -> Column:
    """What is embedded of a chunk: a header, up to 24 symbol names, and the start of its text."""
    symbols = F.when(F.size(names) > 0, F.concat(F.lit("\nSymbols: "), F.array_join(F.slice(names, 1, 24), " "))).otherwise(F.lit(""))
    return F.concat(F.lit("File: "), path, symbols, F.lit("\n```\n"), F.substring(content, 1, 3500), F.lit("\n```"))
