"""Operator 10: telephony audio as columns.

Mu-law and A-law are expanded by lookup tables; IMA ADPCM blocks are decoded with one array step
for each sample position, across all blocks of a group.  PCM is resampled from 8 to 16 kHz by a
four-tap half-band interpolator, in integers.  The media form is RIFF WAVE (format tags 7, 6 and
0x11).  A payload of bytes is stored as it is: one byte is a mu-law or A-law sample, or part of an
ADPCM block of 64 bytes, and is read back from the stored form.

Null or empty text: 64 bytes of 0.  Equal texts, so repeated rows too, give equal values: the codec
follows from the payload.  A very long text's PCM is resampled and stored stretch by stretch with the
samples beside each stretch, so that the result is that of the whole.  An empty table: no rows.  Other
columns are ignored by ``audio_digest``; ``decode_audio`` keeps them and replaces a column named like
its result.  Null media: null; bytes that are no such audio: ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from codeloom.llm import common

# Fixed values of the IMA ADPCM standard.
IMA_INDEX = [-1, -1, -1, -1, 2, 4, 6, 8]
IMA_STEP = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}
BLOCK = 64
RATE = 8000


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((u & 0x0F) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = (a >> 4) & 7, (a & 0x0F) << 4
    size = np.where(part == 0, low + 8, (low + 0x108) << np.maximum(part - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA blocks, one row each: the header's sample, then two for each byte."""
    step, move = np.array(IMA_STEP, np.int32), np.array(IMA_INDEX * 2, np.int32)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((2 * (blocks.shape[1] - 4) + 1, blocks.shape[0]), np.int16)
    out[0] = value
    for k in range(out.shape[0] - 1):
        byte = blocks[:, 4 + k // 2]
        code = (byte >> 4 if k & 1 else byte & 15).astype(np.int32)
        s = step[index]
        d = (s >> 3) + np.where(code & 1, s >> 2, 0) + np.where(code & 2, s >> 1, 0) + np.where(code & 4, s, 0)
        value = np.clip(np.where(code & 8, value - d, value + d), -32768, 32767)
        index = np.clip(index + move[code], 0, 88)
        out[k + 1] = value
    return out.T


def resample_double(pcm: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Twice the rate, for the samples from ``lo`` to ``hi``: these, and behind each of them
    (-a + 9b + 9c - d) / 16 of the four around that place; the ends are repeated."""
    hi = pcm.size if hi is None else hi
    if hi <= lo:
        return np.zeros(0, np.int16)
    x = pcm[np.clip(np.arange(lo - 1, hi + 2), 0, pcm.size - 1)].astype(np.int32)
    between = (9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4
    out = np.empty(2 * (hi - lo), np.int16)
    out[0::2] = x[1:-2]
    out[1::2] = np.clip(between, -32768, 32767)
    return out


def wav(codec: str, data: bytes) -> bytes:
    tag = TAGS[codec]
    if codec == "adpcm":
        per = 2 * (BLOCK - 4) + 1
        fmt = struct.pack("<HHIIHHHH", tag, 1, RATE, RATE * BLOCK // per, BLOCK, 4, 2, per)
        samples = len(data) // BLOCK * per
    else:
        fmt, samples = struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0), len(data)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples & 0xFFFFFFFF) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[str, bytes]:
    """Codec and stored bytes; ``ValueError`` for anything else than these forms."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not RIFF WAVE")
    at, codec, data = 12, None, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            codec = {v: k for k, v in TAGS.items()}.get(struct.unpack_from("<H", media, at + 8)[0])
        elif kind == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if codec is None or data is None:
        raise ValueError("no telephony audio in it")
    return codec, data


def decode_many(media: list[bytes | None]) -> list[np.ndarray | None]:
    """PCM (int16, 8 kHz) of each stored form; ADPCM blocks of all of them together; null: null."""
    out: list[np.ndarray | None] = [None] * len(media)
    parts: list[tuple[int, bytes]] = []
    for k, m in enumerate(media):
        if m is None:
            continue
        codec, data = read_wav(m)
        if codec == "adpcm":
            parts.append((k, data[: len(data) // BLOCK * BLOCK]))
        else:
            out[k] = TABLES[codec][np.frombuffer(data, np.uint8)]
    if parts:
        blocks = np.frombuffer(b"".join(d for _, d in parts), np.uint8).reshape(-1, BLOCK)
        pcm = np.concatenate([adpcm_decode(blocks[i : i + 65536]) for i in range(0, max(1, blocks.shape[0]), 65536)])
        at = 0
        for k, d in parts:
            out[k] = pcm[at : (at := at + len(d) // BLOCK)].reshape(-1)
    return out


def decode_audio(df: DataFrame, media: str = "media", out: str = "pcm", double: bool = True) -> DataFrame:
    """Adds ``out``: 16-bit little-endian PCM of the WAVE bytes in ``media`` (16 kHz if ``double``)."""
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.BinaryType())])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.names.index(media)).to_pylist()
            pcm = [None if p is None else (resample_double(p) if double else p).astype("<i2").tobytes() for p in decode_many(column)]
            yield pa.RecordBatch.from_arrays([pa.array(pcm, pa.binary()) if f.name == out else batch.column(batch.schema.names.index(f.name)) for f in schema.fields], schema.names)

    return df.mapInArrow(run, schema)


class Sound:
    """What the query tells of resampled PCM: its stored form's size and digest, and a feature."""

    def __init__(self, codec: str, pcm: np.ndarray, window: int = 1 << 20):
        self.n, energy, crossings, peak, last = 0, 0, 0, 0, None
        digest = hashlib.sha256()
        for k in range(0, pcm.size, window):
            y = resample_double(pcm, k, min(k + window, pcm.size))
            digest.update(y.astype("<i2").tobytes())
            wide, below = y.astype(np.int64), y < 0
            energy += int(wide @ wide)
            crossings += int(np.count_nonzero(np.diff(below))) + (last is not None and bool(below[0]) != last)
            peak, last, self.n = max(peak, int(np.abs(wide).max())), bool(below[-1]), self.n + y.size
        self.sha256 = digest.hexdigest()
        #: codec, rate, samples, mean energy, zero crossings and peak
        self.feature = f"{codec}:{2 * RATE}:{self.n}:{energy // max(self.n, 1)}:{crossings}:{peak}"


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % BLOCK if raw else BLOCK)


def codec_of(payload: bytes) -> str:
    return sorted(TAGS)[zlib.crc32(payload) % len(TAGS)]


FIELDS = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pcm_bytes", pa.int64()), ("pcm_sha256", pa.string())]
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"


def audio_digest(df: DataFrame) -> DataFrame:
    """Stores each text's bytes as audio, reads them back and describes both and the sound; the
    resampled PCM is what ``decode_audio`` stores (``pcm_bytes``, ``pcm_sha256``)."""

    def run(batches):
        for batch in batches:
            raw, at = common.raw_texts(batch.column(1))
            rows = []
            for i, j in common.groups(at):
                stored = []
                for k in range(i, j):
                    payload = padded(raw[at[k] : at[k + 1]].tobytes())
                    stored.append(wav(codec_of(payload), payload))
                for k, media, pcm in zip(range(i, j), stored, decode_many(stored), strict=True):
                    codec, back = read_wav(media)
                    sound = Sound(codec, pcm)
                    rows.append((int(at[k + 1] - at[k]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), sound.feature, 2 * sound.n, sound.sha256))
            columns = zip(*rows, strict=True) if rows else [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(list(c), kind) for c, (_, kind) in zip(columns, FIELDS, strict=True))], ["doc_id", *(n for n, _ in FIELDS)])

    return df.select("doc_id", common.texts().alias("text")).mapInArrow(run, SCHEMA)


def op10_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_digest(common.table(spark, sf_dir, "documents"))
