"""Operator 12: fill-in-middle forms, cut at units, by an event scan.

A unit is a run of ASCII letters or one other code point.  One Aho-Corasick automaton finds the ASCII
characters that change the class (a letter behind another character, another character behind a
letter) and the sentinels.  Between two such events the class stays, so a gap of letters is one unit
and any other gap has as many units as code points: the number of units before a place, and the place
of the n-th unit, follow from the events alone.  The automaton reads the text with every code point
outside ASCII as ``?``, which is neither a letter nor part of a sentinel, so that places stay.

A text is scanned by stretches; only the number of units before each is held, and the stretch that
holds a cut is scanned again.  Texts of any length so need the memory of one stretch beside
themselves.

``fill_in_middle`` keeps all columns and adds ``units, form, prefix_chars, middle_chars, output``
(replacing columns of these names); ``restore`` gives the text back from ``output`` and ``form``
alone.  Null texts count as empty; empty texts and those that hold a sentinel stay plain.  A null id
is hashed as an empty one.  Equal ids and texts, so repeated rows too, give equal outputs.  An empty
table: no rows.
"""

from __future__ import annotations

import hashlib
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm import common

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
STRETCH = 1 << 16  # code points that are scanned together
OVERLAP = max(map(len, SENTINELS)) - 1
CHANGE, SENTINEL = 0, 1


@cache
def automaton() -> ahocorasick.Automaton:
    letters = [chr(c) for c in range(128) if chr(c).isalpha()]
    others = [chr(c) for c in range(128) if not chr(c).isalpha()]
    a = ahocorasick.Automaton()
    for x in letters:
        for y in others:
            a.add_word(x + y, CHANGE)
            a.add_word(y + x, CHANGE)
    for s in SENTINELS:
        a.add_word(s, SENTINEL)
    a.make_automaton()
    return a


def is_letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


class Scan:
    """Units of a text: their number ``n``, whether it holds a sentinel, and the place of each."""

    def __init__(self, text: str, stretch: int = STRETCH):
        self.text, self.stretch, self.sentinel = text, stretch, False
        before = [0]
        for lo in range(0, len(text), stretch):
            _, _, units = self._gaps(lo)
            before.append(before[-1] + int(units.sum()))
        self.before = np.array(before, np.int64)
        self.n = before[-1]

    def _gaps(self, lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the gaps between the events of a stretch: start, whether of letters, units that start."""
        hi, base = min(lo + self.stretch, len(self.text)), max(lo - OVERLAP, 0)
        changes = []
        for end, kind in automaton().iter(self.text[base:hi].encode("ascii", "replace").decode("ascii")):
            if kind == SENTINEL:
                self.sentinel = True
            else:
                changes.append(end)
        places = np.array(changes, np.int64) + base
        places = places[places >= lo]
        first = is_letter(self.text[lo - 1]) if lo else is_letter(self.text[lo])  # class of the gap before the first event
        starts = np.concatenate([[lo], places])
        letters = (np.arange(starts.size) + first) % 2 == 1
        sizes = np.diff(np.append(starts, hi))
        units = np.where(letters, (sizes > 0).astype(np.int64), sizes)
        if lo and letters[0]:
            units[0] = 0  # a run that goes on from the stretch before
        return starts, letters, units

    def place(self, rank: int) -> int:
        """Where the unit with this number, from 0, starts; the text's end for ``n``."""
        if rank >= self.n:
            return len(self.text)
        k = int(np.searchsorted(self.before, rank, "right")) - 1
        starts, letters, units = self._gaps(k * self.stretch)
        upto = np.cumsum(units)
        g = int(np.searchsorted(upto, rank - self.before[k], "right"))
        inside = 0 if letters[g] else int(rank - self.before[k] - (upto[g] - units[g]))
        return int(starts[g]) + inside


def draws(doc_id: int | None, seed: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def arrange(doc_id: int | None, text: str, seed: str = "1:", rate: int = 90, spm_rate: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, output."""
    scan, (h1, h2, h3, h4) = Scan(text), draws(doc_id, seed)
    if not text or scan.sentinel or h3 % 100 >= rate:
        return scan.n, "plain", None, None, text
    a, b = (scan.place(r) for r in sorted((h1 % (scan.n + 1), h2 % (scan.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = SENTINELS
    spm = h4 % 100 < spm_rate
    output = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
    return scan.n, "spm" if spm else "psm", a, b - a, output


def rebuild(output: str, form: str) -> str:
    """The text of an output.  A sentinel cannot lie across a cut, since no sentinel ends like one begins."""
    if form == "plain":
        return output
    at = [end for end, kind in automaton().iter(output.encode("ascii", "replace").decode("ascii")) if kind == SENTINEL]
    if len(at) != 3 or form not in ("psm", "spm"):
        raise ValueError("not the output of this form")
    one, two, middle = output[at[0] + 1 : at[1] - OVERLAP], output[at[1] + 1 : at[2] - OVERLAP], output[at[2] + 1 :]
    return one + middle + two if form == "psm" else two + middle + one


ADDED = T.StructType().add("units", T.LongType()).add("form", T.StringType()).add("prefix_chars", T.LongType()).add("middle_chars", T.LongType()).add("output", T.StringType())
KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text: str = "text", seed: str = "1:", rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """All columns, with the form's; ``rate`` of 100 texts are cut, ``spm_rate`` of 100 of these suffix first."""
    held = [f for f in df.schema.fields if f.name not in ADDED.names]
    schema = T.StructType(held + ADDED.fields)
    # what the draws read goes beside the columns, so that a column of any name or type may hold it
    inputs = df.select(*[df[f.name] for f in held], F.col(id_col).cast("long").alias("fim_id__"), common.texts(text).alias("fim_text__"))

    def run(batches):
        for batch in batches:
            out = [arrange(i.as_py(), t.as_py(), seed, rate, spm_rate) for i, t in zip(batch.column(len(held)), batch.column(len(held) + 1), strict=True)]
            columns = zip(*out, strict=True) if out else [[]] * len(KINDS)
            yield pa.RecordBatch.from_arrays(batch.columns[: len(held)] + [pa.array(list(c), k) for c, k in zip(columns, KINDS, strict=True)], schema.names)

    return inputs.mapInArrow(run, schema)


def restore(df: DataFrame, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """All columns, with the text that the output was made of; a null output or form: null."""
    held = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*held, T.StructField(out, T.StringType())])
    o, f = schema.names.index(output), schema.names.index(form)

    def run(batches):
        for batch in batches:
            texts = [None if x is None or y is None else rebuild(x, y) for x, y in ((x.as_py(), y.as_py()) for x, y in zip(batch.column(o), batch.column(f), strict=True))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return df.select(*[df[f.name] for f in held]).mapInArrow(run, schema)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle(docs).drop("text")
    back = restore(made)
    return back.select("doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256(concat('1:', doc_id)) AS h FROM documents),
e AS (
  SELECT doc_id, t, u, len(u) AS n, CAST(concat('0x', h[1:8]) AS BIGINT) % (len(u) + 1) AS r1, CAST(concat('0x', h[9:16]) AS BIGINT) % (len(u) + 1) AS r2,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST(concat('0x', h[17:24]) AS BIGINT) % 100 >= 90 AS plain, CAST(concat('0x', h[25:32]) AS BIGINT) % 100 < 20 AS spm
  FROM d),
c AS (
  SELECT doc_id, t, n, plain, spm, array_to_string(u[1:least(r1, r2)], '') AS p, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS m, array_to_string(u[greatest(r1, r2) + 1:n], '') AS s
  FROM e)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN spm THEN concat('<S>', s, '<P>', p, '<M>', m) ELSE concat('<P>', p, '<S>', s, '<M>', m) END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""
