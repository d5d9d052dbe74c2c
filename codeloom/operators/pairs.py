"""Counts of words that stand beside each other, packed by blocks of words.

Distinct pairs outnumber the words of the texts, so no pair is a row before it is scored.  A chunk of
texts gets numbers for its distinct words from the tasks that hold each range of words, counts its own
pairs, and sends them by blocks: words of one range beside words of another, as sorted numbers whose
differences are compressed.  A block adds up what the chunks sent and meets the totals of its words,
arrays in the order of their numbers.  Ranges are as many as keep a block near ``BLOCK`` pairs, so a
word beside all others is spread over all blocks of its range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import keep

CHUNK, BLOCK, SLICE = 1 << 20, 6_000_000, 1 << 16  # words of a chunk, pairs of a block, rows of a batch
LOW = np.int64((1 << 32) - 1)
COUNTS, WORDS = -1, -2  # rows of a range of words itself, beside those for chunks


def packed(**columns) -> bytes:
    batch = pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(blob: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob.as_buffer()).read_next_batch()


def packed_pairs(codes: np.ndarray, count: np.ndarray) -> bytes:
    """Ascending codes as differences, a column for each of their bytes."""
    steps = np.diff(codes, prepend=np.int64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    planes = {f"b{k}": np.ascontiguousarray(steps[:, k]) for k in range(8) if steps[:, k].any()}
    return packed(n=count.astype(np.uint32), **planes)


def unpacked_pairs(blob: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    batch = unpacked(blob)
    steps = np.zeros((batch.num_rows, 8), np.uint8)
    for name in batch.schema.names[1:]:
        steps[:, int(name[1:])] = batch.column(name).to_numpy()
    return np.cumsum(steps.reshape(-1).view("<i8")), batch.column("n").to_numpy()


def _rows(schema: dict, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.values(), strict=True)], list(schema))


def _near(own: np.ndarray, row: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, int]]:
    """Places whose word stands ``d`` places before another of its text, and ``d``."""
    for d in range(1, window + 1):
        yield np.flatnonzero((row[:-d] == row[d:]) & own[:-d]), d


def _chunks(tokens: DataFrame, window: int) -> DataFrame:
    """``chunk, pairs, texts, words``: texts as places in the chunk's distinct words, and these with
    the number of their neighbours.  A long text is cut; what follows a cut is seen from both sides."""

    def run(batches):
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        held, many = [], 0
        for batch in batches:
            lists = batch.column(0)
            at, values = lists.offsets.to_numpy(), lists.values
            for k in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)):
                for low in range(at[k], at[k + 1], CHUNK):
                    own = min(low + CHUNK, at[k + 1]) - low
                    held.append((values.slice(low, min(own + window, at[k + 1] - low)), own))
                    many += own
                    if many >= CHUNK:
                        yield chunk(part << 24 | done, held)
                        held, many, done = [], 0, done + 1
        if held:
            yield chunk(part << 24 | done, held)
        pa.default_memory_pool().release_unused()

    def chunk(name, held):
        coded = pa.concat_arrays([x for x, _ in held]).dictionary_encode()
        place, size = coded.indices.to_numpy(), np.array([len(x) for x, _ in held])
        row = np.repeat(np.arange(size.size), size)
        own = np.arange(row.size) - np.repeat(np.cumsum(size) - size, size) < np.repeat([n for _, n in held], size)
        total, pairs = np.zeros(len(coded.dictionary), np.int64), 0
        for first, d in _near(own, row, window):
            total += np.bincount(place[first], minlength=total.size) + np.bincount(place[first + d], minlength=total.size)
            pairs += first.size
        # the most frequent words get the least places, whose higher bytes are mostly 0
        order = np.argsort(-np.bincount(place, minlength=total.size), kind="stable")
        rank = np.empty(order.size, "<u4")
        rank[order] = np.arange(order.size)
        planes = rank[place].view(np.uint8).reshape(-1, 4).T
        texts = packed(starts=np.diff(row, prepend=-1) > 0, own=own, **{f"b{k}": np.ascontiguousarray(x) for k, x in enumerate(planes)})
        return _rows(schema, [(name, pairs, texts, packed(word=coded.dictionary.take(pa.array(order)), total=total[order]))])

    schema = {"chunk": pa.int64(), "pairs": pa.int64(), "texts": pa.binary(), "words": pa.binary()}
    return tokens.mapInArrow(run, "chunk long, pairs long, texts binary, words binary")


def _numbered(chunks: DataFrame, ranges: int) -> DataFrame:
    """``chunk, range, blob``: for each chunk the numbers of its words in each range; and the words of
    the range in the order of their numbers (chunk ``WORDS``) and their totals (``COUNTS``)."""
    schema = {"chunk": pa.int64(), "range": pa.int32(), "blob": pa.binary()}

    def send(batches):
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words, total = unpacked(blob).columns
                to = np.fromiter((zlib.crc32(w.encode()) % ranges for w in words.to_pylist()), np.int64, len(words))
                order = np.argsort(to, kind="stable").astype(np.int32)
                cuts = np.searchsorted(to[order], np.arange(ranges + 1))
                own = [(r, order[cuts[r] : cuts[r + 1]]) for r in range(ranges) if cuts[r] < cuts[r + 1]]
                yield _rows(schema, [(name, r, packed(place=x, word=words.take(pa.array(x)), total=total.to_numpy()[x])) for r, x in own])

    def number(key, group):
        parts = [unpacked(x) for x in group.column("blob")]
        coded = pa.concat_arrays([p.column("word") for p in parts]).dictionary_encode()
        numbers = coded.indices.to_numpy()
        total = np.bincount(numbers, np.concatenate([p.column("total").to_numpy() for p in parts])).astype(np.int64)
        cuts = np.cumsum([p.num_rows for p in parts])[:-1]
        rows = [(name, packed(place=p.column("place"), number=x)) for name, p, x in zip(group.column("chunk").to_pylist(), parts, np.split(numbers, cuts), strict=True)]
        rows += [(COUNTS, packed(total=total)), (WORDS, packed(word=coded.dictionary))]
        r = key[0].as_py()
        return pa.Table.from_batches([_rows(schema, [(name, r, blob) for name, blob in rows])])

    sent = chunks.select("chunk", "words").mapInArrow(send, "chunk long, range int, blob binary")
    return sent.groupBy("range").applyInArrow(number, "chunk long, range int, blob binary")


def _counted(chunks: DataFrame, numbers: DataFrame, ranges: int, window: int) -> DataFrame:
    """``i, j, side, blob``: each chunk's pairs of words of the ranges ``i <= j``, counted."""
    schema = {"i": pa.int32(), "j": pa.int32(), "side": pa.int32(), "blob": pa.binary()}

    def run(group):
        rows = zip(group.column("range").to_pylist(), group.column("blob"), strict=True)
        answers, texts = [], None
        for r, blob in rows:
            if r < 0:
                texts = unpacked(blob)
            else:
                answers.append((r, unpacked(blob)))
        starts, own, *planes = (c.to_numpy(zero_copy_only=False) for c in texts.columns)
        place = np.stack(planes, 1).view("<u4")[:, 0]
        word = np.zeros(sum(b.num_rows for _, b in answers), np.int64)
        for r, b in answers:
            word[b.column("place").to_numpy()] = b.column("number").to_numpy().astype(np.int64) | np.int64(r) << 32
        order = np.argsort(word)
        rank, word = np.empty_like(order), word[order]
        rank[order] = np.arange(order.size)
        at, row = rank[place], np.cumsum(starts)
        keys = np.empty(sum(x.size for x, _ in _near(own, row, window)), np.int64)
        stop = 0
        for first, d in _near(own, row, window):
            a, b = at[first], at[first + d]
            keys[stop : stop + first.size] = np.minimum(a, b) * word.size + np.maximum(a, b)
            stop += first.size
        keys.sort()
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        count, keys = np.diff(new, append=keys.size), keys[new]
        low, high = word[keys // max(word.size, 1)], word[keys % max(word.size, 1)]
        block = ((low >> 32) * ranges + (high >> 32)).astype(np.int32)
        codes = (low & LOW) << 32 | high & LOW
        by = np.argsort(block, kind="stable")
        names, cuts = np.unique(block[by], return_index=True)
        out = [(int(k) // ranges, int(k) % ranges, -1, packed_pairs(codes[x], count[x])) for k, x in zip(names, np.split(by, cuts[1:]) if by.size else [], strict=True)]
        return pa.Table.from_batches([_rows(schema, out)])

    sides = chunks.select("chunk", F.lit(-1).alias("range"), F.col("texts").alias("blob")).unionByName(numbers.filter("chunk >= 0"))
    return sides.groupBy("chunk").applyInArrow(run, "i int, j int, side int, blob binary")


def _scored(blobs: list[tuple[int, pa.Scalar]], i: int, j: int, every: int) -> tuple[np.ndarray, ...]:
    """A block's pairs of more mutual information than 0: numbers of both words, ``n`` and ``ppmi``."""
    total = {k: unpacked(b).column(0).to_numpy() for k, b in blobs if k >= 0}
    parts = [unpacked_pairs(b) for k, b in blobs if k < 0]
    if not parts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    codes, count = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
    del parts
    by = np.argsort(codes, kind="stable")
    codes = codes[by]
    new = np.flatnonzero(np.diff(codes, prepend=-1))
    n, codes = np.add.reduceat(count[by].astype(np.int64), new), codes[new]
    a, b = codes >> 32, codes & LOW
    if i == j:
        n[a == b] *= 2  # a word beside itself counts from both places
    ppmi = np.log(n.astype(float) * float(every) / (total[i][a].astype(float) * total[j][b].astype(float)))
    good = ppmi > 0
    return a[good], b[good], n[good], ppmi[good]


class Pairs:
    """Packed counts of the pairs of ``tokens`` (one array a text; null and empty ones add none)."""

    def __init__(self, tokens: DataFrame, window: int, block: int = BLOCK):
        chunks = keep(_chunks(tokens, window))
        pairs = chunks.agg(F.sum("pairs")).first()[0] or 0
        self.every, self.ranges = 2 * pairs, max(1, int(np.ceil(np.sqrt(2 * pairs / block))))
        self.numbers = keep(_numbered(chunks, self.ranges))
        self.counted = _counted(chunks, self.numbers, self.ranges, window)  # sent once, so not kept too

    def blocks(self, words: bool) -> DataFrame:
        """``i, j, side, blob``: the pairs of each block (side -1) and the totals of its ranges (their
        number); with ``words`` these too (``-2 - range``)."""
        held = self.numbers.filter(F.col("chunk").isin([COUNTS, WORDS] if words else [COUNTS]))
        other = F.explode(F.sequence(F.lit(0), F.lit(self.ranges - 1))).alias("other")
        side = F.when(F.col("chunk") == COUNTS, F.col("range")).otherwise(-2 - F.col("range"))
        spread = held.select("range", side.alias("side"), "blob", other).select(F.least("range", "other").alias("i"), F.greatest("range", "other").alias("j"), "side", "blob")
        return self.counted.unionByName(spread)

    def rows(self) -> DataFrame:
        """``a, b, n, ppmi`` in both directions, where that is above 0."""
        every = self.every

        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            i, j = (k.as_py() for k in key)
            blobs = [x for batch in batches for x in zip(batch.column("side").to_pylist(), batch.column("blob"), strict=True)]
            word = {-2 - k: unpacked(b).column(0) for k, b in blobs if k <= -2}
            a, b, n, ppmi = _scored([x for x in blobs if x[0] >= -1], i, j, every)
            for low in range(0, a.size, SLICE):
                at = slice(low, low + SLICE)
                x, y = word[i].take(pa.array(a[at])), word[j].take(pa.array(b[at]))
                yield pa.RecordBatch.from_arrays([x, y, pa.array(n[at]), pa.array(ppmi[at])], ["a", "b", "n", "ppmi"])
                turned = pa.array((a[at] != b[at]) | (i != j))
                yield pa.RecordBatch.from_arrays([y, x, pa.array(n[at]), pa.array(ppmi[at])], ["a", "b", "n", "ppmi"]).filter(turned)

        return self.blocks(True).groupBy("i", "j").applyInArrow(run, "a string, b string, n long, ppmi double")

    def sums(self, places: int = 6) -> DataFrame:
        """``term, company, n, ppmi``: for each word with pairs of more mutual information than 0 their
        number, their counts, and the exact sum of their mutual information, rounded to ``places``."""
        every, unit = self.every, 10**places

        def add(key, group):
            i, j = (k.as_py() for k in key)
            a, b, n, ppmi = _scored(list(zip(group.column("side").to_pylist(), group.column("blob"), strict=True)), i, j, every)
            value, once = np.floor(ppmi * unit + 0.5), (a != b) | (i != j)
            sides = [(i, a, n, value), (j, b[once], n[once], value[once])]
            if i == j:
                sides = [(i, *(np.concatenate([x, y]) for x, y in zip(sides[0][1:], sides[1][1:], strict=True)))]
            out = []
            for r, word, n, value in sides:
                company = np.bincount(word)
                at = np.flatnonzero(company)
                if at.size:  # sums below 2^53 are exact
                    out.append((r, packed(number=at.astype(np.int32), company=company[at], n=np.bincount(word, n)[at].astype(np.int64), ppmi=np.bincount(word, value)[at].astype(np.int64))))
            return pa.Table.from_batches([_rows({"range": pa.int32(), "blob": pa.binary()}, out)])

        def gather(group):
            chunk = group.column("chunk").to_pylist()
            blobs = group.column("blob")
            words = unpacked(blobs[chunk.index(WORDS)]).column(0)
            company, n, ppmi = np.zeros((3, len(words)), np.int64)
            for k, c in enumerate(chunk):
                if c != WORDS:
                    at, *own = (x.to_numpy() for x in unpacked(blobs[k]).columns)
                    for to, x in zip((company, n, ppmi), own, strict=True):
                        to[at] += x
            at = np.flatnonzero(company)
            return pa.Table.from_arrays([words.take(pa.array(at)), pa.array(company[at]), pa.array(n[at]), pa.array(ppmi[at] / unit)], names=["term", "company", "n", "ppmi"])

        parts = self.blocks(False).groupBy("i", "j").applyInArrow(add, "range int, blob binary")
        each = parts.select(F.lit(0).cast("long").alias("chunk"), "range", "blob").unionByName(self.numbers.filter(F.col("chunk") == WORDS))
        return each.groupBy("range").applyInArrow(gather, "term string, company long, n long, ppmi double")
