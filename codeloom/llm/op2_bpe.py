"""Operator 2: byte-level BPE encoding and decoding as a streaming transducer (see ``bpe``).

Texts of up to ``chunk`` bytes are encoded in groups; longer ones pass through the transducer in
chunks, tokens being emitted once the merge list's lookahead proves them final.  Null text: no
tokens.  Repeated rows are encoded each for itself.  An output column replaces an input column of
the same name; other columns pass through.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from codeloom.llm import bpe, common

CHUNK = 1 << 16


def encoded(path: str, column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
    """Row number and the portions of its ids, in row order."""
    enc = bpe.encoder(path)
    raw, at = common.raw_texts(column)
    for i, j in common.groups(at, max(chunk, common.GROUP_BYTES)):
        if j == i + 1 and at[j] - at[i] > chunk:
            yield i, _streamed(enc, raw[at[i] : at[j]], chunk)
            continue
        # long ones of a group go through the transducer, the others together
        whole = np.flatnonzero(np.diff(at[i : j + 1]) <= chunk) + i
        size = at[whole + 1] - at[whole]
        own = np.concatenate([[0], np.cumsum(size)])
        buf = raw[at[i] : at[j]] if whole.size == j - i else np.concatenate([raw[at[k] : at[k + 1]] for k in whole] or [raw[:0]])
        ids, starts, before = enc.encode(buf, common.text_starts(own))
        bound = before[np.searchsorted(starts, own)]
        place = dict(zip(whole.tolist(), range(whole.size), strict=True))
        for k in range(i, j):
            if (p := place.get(k)) is not None:
                yield k, iter([ids[bound[p] : bound[p + 1]]])
            else:
                yield k, _streamed(enc, raw[at[k] : at[k + 1]], chunk)


def _streamed(enc: bpe.ChunkEncoder, raw: np.ndarray, chunk: int) -> Iterator[np.ndarray]:
    stream = bpe.StreamingEncoder(enc, chunk)
    for k in range(0, raw.size, chunk):
        yield stream.feed(raw[k : k + chunk].tobytes())
    yield stream.finish()


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def _put(batch: pa.RecordBatch, schema: T.StructType, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([values if f.name == name else batch.column(batch.schema.names.index(f.name)) for f in schema.fields], schema.names)


def bpe_encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """Adds ``out``: the token ids of ``text`` as ``array<int>``."""
    schema = _with(df, out, T.ArrayType(T.IntegerType()))

    def run(batches):
        for batch in batches:
            ids = [np.concatenate([*parts, np.zeros(0, np.uint32)]).astype(np.int32) for _, parts in encoded(path, batch.column(batch.schema.names.index(text)), chunk)]
            yield _put(batch, schema, out, pa.array(ids, pa.list_(pa.int32())))

    return df.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", portion: int = 1 << 16) -> DataFrame:
    """Adds ``out``: the text of ``ids``; bytes that make no character become U+FFFD, null: empty."""
    schema = _with(df, out, T.StringType())

    def run(batches):
        for batch in batches:
            decoder, texts = bpe.StreamingDecoder(bpe.merge_table(path)), []
            for row in batch.column(batch.schema.names.index(ids)):
                got = np.array(row.as_py() or [], np.int64)
                texts.append("".join(decoder.feed(got[k : k + portion]) for k in range(0, got.size, portion)) + decoder.finish())
            yield _put(batch, schema, out, pa.array(texts, pa.string()))

    return df.mapInArrow(run, schema)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_digest(df: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """Encodes and decodes each text without holding either: counts and digests of both."""

    def run(batches):
        for batch in batches:
            decoder, rows = bpe.StreamingDecoder(bpe.merge_table(path)), []
            for k, parts in encoded(path, batch.column(1), chunk):
                n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
                for ids in parts:
                    n += ids.size
                    ids_hash.update(ids.astype("<u4").tobytes())
                    text_hash.update(decoder.feed(ids).encode())
                text_hash.update(decoder.finish().encode())
                rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(list(c), kind) for c, kind in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", common.texts().alias("text")).mapInArrow(run, DIGEST)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(common.table(spark, sf_dir, "documents"), common.default_tokenizer())
