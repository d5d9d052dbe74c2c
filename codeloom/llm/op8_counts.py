"""Operator 8: token counts by overlap resynchronisation.

A huge text is cut into chunks that overlap; all are encoded with offsets.  Two neighbours are
spliced at a boundary that both have and that is proven: the splitting pattern never looks behind,
so once both start a piece at ``p`` they agree on everything after it, and what lies before ``p`` is
final in the left one when ``p`` keeps a guard from its end.  Where the overlap holds no such
boundary it is doubled, up to the whole text.

Null text: 0 bytes and 0 tokens.  Rows are counted each for itself, extra columns pass through, and
``n_bytes``, ``n_tokens`` and ``over_limit`` replace input columns of these names.
"""

from __future__ import annotations

import functools
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from codeloom.llm import bpe, common

CHUNK, OVERLAP, GUARD = 1 << 15, 1 << 10, 64


class Backend(Protocol):
    def spans(self, windows: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window: byte offsets of piece starts, and tokens before each of them; at the
        end the window's size and number of tokens."""


class ByteBpe:
    """Byte-level BPE through the array encoder."""

    def __init__(self, path: str):
        self.encoder = bpe.encoder(path)

    def spans(self, windows):
        at = np.concatenate([[0], np.cumsum([len(w) for w in windows])])
        buf = np.frombuffer(b"".join(windows), np.uint8)
        _, starts, before = self.encoder.encode(buf, common.text_starts(at), with_ids=False)
        cut = np.searchsorted(starts, at)
        return [(np.append(starts[a:b], at[k + 1]) - at[k], before[a : b + 1] - before[a]) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]


class Library:
    """Any ``tokenizers`` file whose pieces are found without looking behind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def spans(self, windows):
        out = []
        for w, e in zip(windows, self.tokenizer.encode_batch([w.decode() for w in windows], add_special_tokens=False), strict=True):
            text, words = w.decode(), e.word_ids
            new = [k for k in range(len(words)) if not k or words[k] is None or words[k] != words[k - 1]]
            size = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
            out.append((np.array([size[e.offsets[k][0]] for k in new] + [len(w)], np.int64), np.array([*new, len(words)], np.int64)))
        return out


class SentencePiece:
    """A sentencepiece model.  It normalises texts, so no offset inside a window is proven: the
    overlap of a huge text widens to the whole of it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def spans(self, windows):
        return [(np.array([0, len(w)], np.int64), np.array([0, len(self.model.encode(w.decode()))], np.int64)) for w in windows]


@functools.lru_cache(maxsize=4)
def backend(path: str) -> Backend:
    if path.endswith(".model"):
        return SentencePiece(path)
    try:
        return ByteBpe(path)
    except (KeyError, ValueError):  # not a byte-level vocabulary
        return Library(path)


def _cut(raw: bytes, at: int) -> int:
    """``at``, moved back to the start of a character."""
    at = min(at, len(raw))
    while 0 < at < len(raw) and (raw[at] & 0xC0) == 0x80:
        at -= 1
    return at


def spliced(raw: bytes, by: Backend, chunk: int = CHUNK, overlap: int = OVERLAP, group: int = 32) -> int:
    """Tokens of one huge text; at most ``group`` chunks are held encoded at a time."""
    bounds = [*dict.fromkeys(_cut(raw, k) for k in range(0, len(raw), chunk)), len(raw)]
    total, k, since = 0, 0, 0  # since: the proven start, in the text, of what is not yet counted
    ready: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    last = len(bounds) - 2
    while k <= last:
        if k not in ready:
            ks = range(k, min(k + group, last + 1))
            ready = dict(zip(ks, by.spans([raw[bounds[i] : _cut(raw, bounds[i + 1] + overlap)] for i in ks]), strict=True))
        starts, before = ready[k]
        starts = starts + bounds[k]
        nxt, reach = k + 1, overlap
        while nxt <= last:
            if nxt not in ready:
                ready |= {nxt: by.spans([raw[bounds[nxt] : _cut(raw, bounds[nxt + 1] + overlap)], b""])[0]}
            other = ready[nxt][0] + bounds[nxt]
            end = int(starts[-1])
            mine = starts[:-3] if starts.size > 3 else starts[:0]
            both = np.intersect1d(mine[(mine >= since) & (mine <= end - GUARD)], other[1:-1] if end < len(raw) else other[:-1])
            both = both[both > since]
            if both.size:
                break
            reach *= 2  # widen; past the next chunk, that one is taken in
            stop = _cut(raw, bounds[nxt] + reach)
            starts, before = by.spans([raw[bounds[k] : stop], b""])[0]
            starts = starts + bounds[k]
            if stop >= len(raw):
                nxt = last + 1
            elif nxt < last and stop >= bounds[nxt + 1]:
                nxt += 1
        else:
            return total + int(before[-1]) - int(before[np.searchsorted(starts, since)])
        p = int(both[0])
        total += int(before[np.searchsorted(starts, p)] - before[np.searchsorted(starts, since)])
        since = p
        k = nxt
    return total


def count_batch(column: pa.Array, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each row."""
    by = backend(path)
    raw, at = common.raw_texts(column)
    n = np.zeros(at.size - 1, np.int64)
    for i, j in common.groups(at):
        rows = [k for k in range(i, j) if at[k + 1] - at[k] <= chunk]
        for k, (_, before) in zip(rows, by.spans([raw[at[k] : at[k + 1]].tobytes() for k in rows]) if rows else [], strict=True):
            n[k] = before[-1]
        for k in range(i, j):
            if at[k + 1] - at[k] > chunk:
                n[k] = spliced(raw[at[k] : at[k + 1]].tobytes(), by, chunk, overlap)
    return np.diff(at), n


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit`` and drops ``text``."""
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    others = [f for f in df.schema.fields if f.name != text and f.name not in {x.name for x in new}]
    schema = T.StructType(others + new)

    def run(batches):
        for batch in batches:
            size, n = count_batch(batch.column(batch.schema.names.index(text)), path, chunk, overlap)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(f.name)) for f in others), pa.array(size), pa.array(n), pa.array(n > limit)], schema.names)

    return df.mapInArrow(run, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.default_tokenizer())
