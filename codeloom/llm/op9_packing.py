"""Operator 9: packing token sequences by swap-based local search.

Only documents of more than ``capacity`` tokens are cut; the first piece takes what is left over,
the others are full and are sequences by themselves.  The other pieces are dealt to shards of a
bounded number of pieces by a hash of their row, so no document, source or group of copies, not
even of rows that repeat, can make one shard large.  A shard is packed best-fit decreasing, and then
improved by local search: pieces are moved, or exchanged one for one, two for one and one for two,
from the least filled bins into fuller ones.  Each pass raises the sum of squared fills or empties a
bin, so the search ends; it stops early when the bins are as many as the tokens need at least.
The bins of a shard that are not nearly full are pooled and packed once more.

Null or empty text: one place for the end token alone.  Repeated rows are packed each for itself.  An
empty table: no rows.  Very long texts are cut as above.  Other columns, whatever their names, are
ignored.  Ties in a shard go by length, then doc_id, piece and checksum; which shard a piece goes to
depends on its row's place in the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import common, op2_bpe

CAPACITY, END, SHARD = 1024, 2, 20_000
WINDOWS, EFFORT = (192, 48, 8), 400  # pieces in the pool of a pass, and passes for a shard, at most
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, bin long, offset long, fill long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece of ``n`` tokens."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((k, capacity) for k in range(first, n, capacity))]


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Tokenises ``doc_id, text`` and returns the pieces."""

    def run(batches):
        for batch in batches:
            ids_of, rows = batch.column(0).to_pylist(), []
            for k, parts in op2_bpe.encoded(path, batch.column(1)):
                raw = np.concatenate([*parts, np.array([end], np.uint32)]).astype("<u4")
                for p, (start, length) in enumerate(cut(raw.size, capacity)):
                    rows.append((ids_of[k], p, start, length, zlib.crc32(raw[start : start + length])))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), common.texts().alias("text")).mapInArrow(run, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; ``sizes`` descend.  The fullest bin with room takes the item."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with r left
    for item, size in enumerate(sizes):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


class Pool:
    """Pieces of underfull bins by size, with bit sets of the sizes and of the sums of two of them."""

    def __init__(self, items: list[int], sizes: list[int]):
        self.by: dict[int, list[int]] = {}
        for i in items:
            self.by.setdefault(sizes[i], []).append(i)
        self.one = sum(1 << s for s in self.by)
        self._two: int | None = None

    @property
    def two(self) -> int:
        if self._two is None:
            self._two = 0
            for s, held in self.by.items():
                self._two |= (self.one if len(held) > 1 else self.one & ~(1 << s)) << s
        return self._two

    def take(self, size: int) -> int:
        held = self.by[size]
        item = held.pop()
        if not held:
            del self.by[size]
            self.one &= ~(1 << size)
        self._two = None
        return item

    def put(self, size: int, item: int) -> None:
        self.by.setdefault(size, []).append(item)
        self.one |= 1 << size
        self._two = None

    def items(self) -> list[int]:
        return [i for held in self.by.values() for i in held]


def best_step(there: list[int], sizes: list[int], room: int, pool: Pool) -> tuple[int, tuple[int, ...], int, int]:
    """The step that fills a bin most: its gain, the pieces that leave, how many come, their size.

    A move brings one piece, exchanges are one for one, two for one and one for two."""
    best: tuple[int, tuple[int, ...], int, int] = (0, (), 0, 0)
    window = (1 << room) - 1

    def look(size: int, out: tuple[int, ...], come: int, held: int) -> bool:
        nonlocal best
        gain = (held >> size + 1 & window).bit_length()
        if gain > best[0]:
            best = gain, out, come, size + gain
        return best[0] == room

    singles = list({sizes[i]: i for i in there}.items())
    if look(0, (), 1, pool.one) or any(look(s, (i,), 1, pool.one) for s, i in singles) or any(look(s, (i,), 2, pool.two) for s, i in singles):
        return best
    pairs = {s + sizes[j]: (i, j) for s, i in singles for j in there if j != i}
    any(look(s, out, 1, pool.one) for s, out in pairs.items())
    return best


def stepped(there: list[int], sizes: list[int], pool: Pool, step: tuple[int, tuple[int, ...], int, int]) -> list[int]:
    _, out, come, size = step
    if come == 1:
        new = [pool.take(size)]
    else:
        first = next(s for s, held in pool.by.items() if size - s in pool.by and (2 * s != size or len(held) > 1))
        new = [pool.take(first), pool.take(size - first)]
    for i in out:
        pool.put(sizes[i], i)
    return [i for i in there if i not in out] + new


def improve(bins: list[list[int]], sizes: list[int], capacity: int, effort: int = EFFORT) -> list[list[int]]:
    """Local search that raises the squared fill until bins are empty.

    In each pass a window of underfull bins, from the emptiest, is the pool; each fuller bin takes its
    best steps from it, and what the pool has left is packed again.  A pass counts if fewer bins or a
    greater squared fill come of it; then the next starts at the emptiest bins again.  The search ends
    with as many bins as the tokens need at least, when no window of any of the ``WINDOWS`` gives a
    step, or after ``effort`` passes."""
    least = -(-sum(sizes[i] for b in bins for i in b) // capacity)
    filled = [(sum(sizes[i] for i in b), b) for b in bins if b]
    shut, ajar = [x for x in filled if x[0] == capacity], [x for x in filled if x[0] < capacity]
    size, at, calm = 0, 0, 0
    while len(ajar) > 1 and len(ajar) + len(shut) > least and effort > 0:
        effort -= 1
        ajar.sort(key=lambda x: x[0])
        at = at if at < len(ajar) else 0
        stop, many = at, 0
        while stop < len(ajar) and stop - at < max(1, len(ajar) - 1) and (many < WINDOWS[size] or stop - at < 2):
            many += len(ajar[stop][1])
            stop += 1
        own, rest = ajar[at:stop], ajar[:at] + ajar[stop:]
        pool, new, gained = Pool([i for _, b in own for i in b], sizes), [], False
        for fill, b in reversed(rest):
            while fill < capacity and fill >= own[0][0] and (step := best_step(b, sizes, capacity - fill, pool))[0]:
                b, fill, gained = stepped(b, sizes, pool, step), fill + step[0], True
            new.append((fill, b))
        left = sorted(pool.items(), key=lambda i: (-sizes[i], i))
        packed = [[left[k] for k in b] for b in best_fit([sizes[i] for i in left], capacity)]
        again = [(sum(sizes[i] for i in b), b) for b in packed] + new
        if len(again) < len(ajar) or (len(again) == len(ajar) and sum(f * f for f, _ in again) > sum(f * f for f, _ in ajar)):
            shut += [x for x in again if x[0] == capacity]
            ajar = [x for x in again if x[0] < capacity]
            at, calm = (0 if gained else stop), 0
        else:
            calm, at = calm + stop - at, stop
            if calm >= len(ajar):
                if size + 1 == len(WINDOWS):
                    break
                size, at, calm = size + 1, 0, 0
    return [b for _, b in shut + ajar]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions in ``lengths``."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    sizes = [lengths[i] for i in order]
    return [[order[i] for i in b] for b in improve(best_fit(sizes, capacity), sizes, capacity)]


def _packed(shards: DataFrame, capacity: int) -> DataFrame:
    """Packs each ``shard``; a bin's number is ``shard << 32 | n``."""

    def run(key, group):
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = group.column("length").to_pylist()
        n = len(lengths)
        bins, offsets, fills = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b, items in enumerate(pack(lengths, capacity)):
            at = 0
            for i in items:
                bins[i], offsets[i] = (key[0].as_py() << 32) | b, at
                at += lengths[i]
            fills[items] = at
        return group.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("bin", pa.array(bins)).append_column("offset", pa.array(offsets)).append_column("fill", pa.array(fills))

    return shards.groupBy("shard").applyInArrow(run, PLACED)


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, shard: int = SHARD) -> DataFrame:
    """Pieces of ``doc_id, text`` with ``sequence_id`` and ``offset``."""
    cut_up = common.keep(pieces(df, path, capacity, end))
    part = F.col("length") < capacity
    n = cut_up.filter(part).count()
    shards = max(1, -(-n // shard))
    first = common.keep(_packed(cut_up.filter(part).withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))), capacity))
    full = cut_up.filter(~part).select(*(c.split(" ")[0] for c in PIECES.split(", ")), (F.monotonically_increasing_id() * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    columns = full.columns
    if shards == 1:
        return full.unionByName(first.select(*columns[:5], (F.col("bin") * 4 + 1).alias("sequence_id"), "offset"))
    # second round: what the bins that are not nearly full hold
    low = F.col("fill") < capacity * 7 // 8
    left = first.filter(low)
    again = max(1, -(-left.count() // shard))
    second = _packed(left.withColumn("shard", F.pmod(F.xxhash64("bin"), F.lit(again))), capacity)
    return full.unionByName(first.filter(~low).select(*columns[:5], (F.col("bin") * 4 + 1).alias("sequence_id"), "offset")).unionByName(second.select(*columns[:5], (F.col("bin") * 4 + 2).alias("sequence_id"), "offset"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"), common.default_tokenizer())
