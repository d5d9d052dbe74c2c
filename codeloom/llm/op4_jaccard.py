"""Operator 4: n-gram Jaccard join with signature trees.

1. Each document becomes its set of distinct word shingles (64-bit hashes).  Sets with the same two
   independent 64-bit hashes are one node, so copies of a text are never compared with each other.
2. Shingles are counted exactly, over all documents: each chunk of documents sends the distinct codes
   (leading 48 bits) of the lower part of the hash range, packed by ranges of codes, and gets their
   levels back (the logarithm of the count).  Any order of shingles that all documents share makes
   prefix filtering exact: sets that reach the threshold share one of their first
   ``n - ceil(t n) + 1``.  The order is (level, code) in the counted range and by code behind it, so
   passages which many documents share hardly ever are candidates, at any size of the corpus, and a
   code that was counted once is not sent at all.  Of copies of a text one is counted.
3. Leaves: sets are dealt to groups of bounded size by the least of their prefix codes under
   ``ROUNDS`` hashes, and a signature tree is traversed in each; near copies nearly always meet here,
   and each set is sent ``ROUNDS`` times at most.
4. What is left: codes whose documents are not all linked by now.  Sets that share such a code are a
   group.  A small group is one signature tree.  In a large one, whose sets may all be like one another
   without being linked, each set is replaced by its differences from the group's base (the shingles of
   over half of a few sampled sets; any base gives the same links).  Sets near to the base are linked
   outright; any other two that link have shared differences, so a prefix filter on these, the rarest
   first, deals them to trees.  Each set goes to one tree for each shared code in its prefix (and to
   ``many / 512`` parts of one where more than 512 sets share the code), not to every block of its group.
   In a tree (nodes with OR-combined bitmaps and size ranges), pairs of nodes are pruned when their
   sizes or their largest possible overlap cannot reach the threshold, or when all their documents
   are linked already; pairs that are left are compared exactly, by whole sets.
5. The links' connected components are the classes.

Null or empty texts have an empty set and no links; texts with fewer words than a shingle have one
shingle, the whole sequence.  Repeated rows and copies get the class of their set.  Null ids are
kept, link to nothing and are nobody's smallest id.  Very long texts are cut into shingles by
stretches and held as one set each.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import common
from codeloom.llm.components import Forest, components, join_hot

BLOCK, ROUNDS = 64, 3
WORDS = 32  # of 64 bits in a bitmap
CODE_BITS, COUNTED = 48, 0.4  # bits of a code, and the part of the hash range that is counted
CHUNK, BUCKET = 1 << 18, 1 << 19  # codes of a chunk of documents, and of a range, about
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_AT = mix(np.arange(1 << 12, dtype=np.uint64) + _PLACE[4]) | np.uint64(1)


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of the words of ``buf``, lower-cased from A to Z; a 0x20 ends each row.

    A word is the sum of its bytes' numbers, each multiplied by a random odd number of its place."""
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf)
    gap = (low == 32) | ((low >= 9) & (low <= 13))
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not starts.size:
        return starts, np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    weight = _AT[place & 4095] if size.max() <= 4096 else np.where(place < 4096, _AT[place & 4095], mix(place.astype(np.uint64) + _PLACE[4]) | np.uint64(1))
    total = np.add.reduceat(_BYTE[low[~gap]] * weight, first)
    return starts, mix(total + size.astype(np.uint64) * _STEP)


def shingle_sets(column: pa.Array, width: int = 5):
    """Row number and sorted distinct shingle hashes (uint64) of each row."""
    raw, at = common.raw_texts(column)
    for i, j in common.groups(at):
        if j == i + 1 and at[j] - at[i] > 2 * common.GROUP_BYTES:
            yield i, _shingles(_long_words(raw[at[i] : at[j]]), width)
            continue
        size = np.diff(at[i : j + 1])
        buf = np.full(int(size.sum()) + j - i, 32, np.uint8)
        keep = np.ones(buf.size, bool)
        stops = np.cumsum(size + 1) - 1
        keep[stops] = False
        buf[keep] = raw[at[i] : at[j]]
        starts, words = word_hashes(buf)
        cut = np.concatenate([[0], np.searchsorted(starts, stops)])
        for k in range(j - i):
            yield i + k, _shingles(words[cut[k] : cut[k + 1]], width)


def _long_words(raw: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, in stretches that end at a gap."""
    gaps = np.flatnonzero((raw == 32) | ((raw >= 9) & (raw <= 13)))
    out, at = [], 0
    while at < raw.size:
        k = int(np.searchsorted(gaps, at + common.GROUP_BYTES))
        stop = int(gaps[k]) + 1 if k < gaps.size else raw.size
        out.append(word_hashes(raw[at:stop])[1])
        at = stop
    return np.concatenate(out)


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    place = np.resize(_PLACE, width)
    place[5:] = mix(np.arange(5, width, dtype=np.uint64)) | np.uint64(1)
    if words.size >= width:
        rolled = np.zeros(words.size - width + 1, np.uint64)
        for k in range(width):
            rolled += words[k : k + rolled.size] * place[k]
        return np.unique(mix(rolled))
    if words.size:
        return mix((words * place[: words.size]).sum(keepdims=True) + np.array([words.size], np.uint64) * _STEP)
    return np.zeros(0, np.uint64)


def set_hashes(tokens: np.ndarray) -> tuple[int, int]:
    """Two numbers of the set as a whole, whatever its order; signed 64 bits each."""
    size = np.array([tokens.size], np.uint64) * _STEP
    return tuple(int(mix(mix(tokens ^ p).sum(keepdims=True) + size)[0].astype(np.int64)) for p in _PLACE[:2])


def prefix_size(n, threshold: int):
    return n - -(-threshold * n // 100) + 1


CHUNKED = "chunk long, bucket int, total long, blob binary"


def packed_codes(codes: np.ndarray) -> bytes:
    """Ascending codes as differences of the fewest bytes that hold them all."""
    steps = np.diff(codes, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked_codes(blob: bytes) -> np.ndarray:
    width = blob[0]
    steps = np.zeros((len(blob) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


class Sets:
    """A chunk's sets: sizes, hashes and, set by set, the codes that may be in a prefix."""

    def __init__(self, n, h, h2, many, codes):
        self.n, self.h, self.h2, self.many, self.codes = n, h, h2, many, codes

    def dump(self) -> bytes:
        six = self.codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : CODE_BITS // 8]
        return b"".join([np.int64(self.n.size).tobytes(), self.n.tobytes(), self.h.tobytes(), self.h2.tobytes(), self.many.tobytes(), six.tobytes()])

    @staticmethod
    def load(blob: bytes) -> Sets:
        k = int(np.frombuffer(blob, np.int64, 1)[0])
        four = np.frombuffer(blob, np.int64, 4 * k, 8).reshape(4, k)
        codes = np.zeros((int(four[3].sum()), 8), np.uint8)
        codes[:, : CODE_BITS // 8] = np.frombuffer(blob, np.uint8, offset=8 + 32 * k).reshape(-1, CODE_BITS // 8)
        return Sets(*four, codes.reshape(-1).view("<u8"))


def text_key():
    """Tells rows that repeat an id apart."""
    return F.xxhash64("text").alias("text_key")


class Filter:
    """A bitmap of fixed size (8 MB) over hashed keys; where it fills up it lets more rows pass."""

    BITS = 26

    def __init__(self, wanted: DataFrame, keys: list[str]):
        self.keys = keys
        parts = wanted.select(self.place().alias("at")).groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"))
        self.parts = common.keep(parts)

    def place(self, *keys: str):
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(1 << self.BITS))

    def holds(self):
        """For Python workers: whether places are in the bitmap."""
        bits = np.zeros((1 << self.BITS - 15, 1 << 12), np.uint8)
        for row in self.parts.collect():  # 8 MB at most
            bits[row.bucket - 1] = np.frombuffer(row.bits, np.uint8)
        shared = self.parts.sparkSession.sparkContext.broadcast(bits)
        return lambda at: (shared.value[at >> 15, (at & 32767) >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def marked(self, rows: DataFrame, name: str, *keys: str) -> DataFrame:
        """Adds whether rows may be among those wanted, without a Python worker beside the task's own."""
        bits = F.broadcast(self.parts.select(F.col("bucket").alias("bucket__"), F.col("bits").alias("bits__")))  # 8 MB at most
        placed = rows.withColumn("at__", self.place(*keys)).withColumn("bucket__", F.expr("at__ div 32768 + 1")).join(bits, "bucket__", "left")
        byte = "cast(conv(hex(substring(bits__, cast((at__ & 32767) div 8 as int) + 1, 1)), 16, 10) as int)"
        return placed.withColumn(name, F.coalesce(F.expr(f"shiftright({byte}, cast(at__ & 7 as int)) & 1 = 1"), F.lit(False))).drop("at__", "bucket__", "bits__")


def copies(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key`` of rows that repeat the text of a row with a smaller id; texts are told
    apart by 128 bits."""
    keyed = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), F.xxhash64(F.lit(1), "text").alias("other"))
    groups = keyed.groupBy("text_key", "other").agg(F.min("doc_id").alias("first"), F.count("*").alias("many")).filter("many > 1")
    return join_hot(keyed, common.keep(groups), ["text_key", "other"], "many").filter("doc_id > first").select("doc_id", "text_key")


def describe(docs: DataFrame, again: Filter | None, threshold: int, width: int = 5) -> DataFrame:
    """``doc_id, text_key, n, h, h2`` of each row, and in rows with a ``blob`` the sets of a chunk of
    rows, but for those that ``again`` holds and for null ids.

    Kept of a set: its codes in the counted range, or as many as its prefix takes if these are more."""
    limit = np.uint64(int(COUNTED * 2.0**64))
    held_by = again.holds() if again else lambda at: np.zeros(at.size, bool)

    def run(batches):
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        held, seen, many = [], set(), 0
        for batch in batches:
            n, h, h2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            chosen = ~held_by(batch.column(3).to_numpy()) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for k, tokens in shingle_sets(batch.column(1), width):
                if not tokens.size:
                    continue
                n[k] = tokens.size
                h[k], h2[k] = name = set_hashes(tokens)
                if not chosen[k] or name in seen:
                    continue
                seen.add(name)
                take = max(int(np.searchsorted(tokens, limit)), prefix_size(tokens.size, threshold))
                held.append((tokens.size, *name, tokens[:take] >> np.uint64(64 - CODE_BITS)))
                many += take
                if many > CHUNK:
                    yield chunk(part, done, held)
                    held, seen, many, done = [], set(), 0, done + 1
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(h), pa.array(h2), none, pa.nulls(batch.num_rows, pa.binary())], names)
        if held:
            yield chunk(part, done, held)
        pa.default_memory_pool().release_unused()

    def chunk(part, done, held):
        n, h, h2, codes = zip(*held, strict=True)
        blob = Sets(*(np.array(x, np.int64) for x in (n, h, h2)), np.array([c.size for c in codes], np.int64), np.concatenate(codes)).dump()
        none = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array([sum(c.size for c in codes)], pa.int64()), none, none, pa.array([part << 24 | done], pa.int64()), pa.array([blob], pa.binary())], names)

    names = ["doc_id", "text_key", "n", "h", "h2", "chunk", "blob"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.texts().alias("text"), text_key())
    return rows.withColumn("at", again.place() if again else F.lit(0).cast("long")).mapInArrow(run, "doc_id long, text_key long, n long, h long, h2 long, chunk long, blob binary")


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of a chunk that lie in the counted range, and how often each stands there."""
    return np.unique(codes[codes < np.uint64(int(COUNTED * 2.0**CODE_BITS))], return_counts=True)


def levels(chunks: DataFrame, buckets: int) -> DataFrame:
    """For each chunk and range of codes the levels of its distinct codes, in ascending order."""
    span = np.uint64(-(-(1 << CODE_BITS) // buckets))

    def send(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, count = counted(Sets.load(blob.as_py()).codes)
                cuts = np.flatnonzero(np.diff(codes // span, prepend=np.uint64(1 << 63)))
                rows = []
                for lo, hi in zip(cuts, np.append(cuts[1:], codes.size)[: cuts.size], strict=True):  # none where no code is counted
                    rows.append((chunk, int(codes[lo] // span), hi - lo, packed_codes(codes[lo:hi]) + zlib.compress(count[lo:hi].astype("<u4").tobytes(), 1)))
                yield records(rows)

    def records(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["chunk", "bucket", "total", "blob"])

    def add(group):
        """All counts of one range of codes; the answer for each chunk is its codes' levels."""
        parts = []
        for total, blob in zip(group.column("total").to_pylist(), group.column("blob"), strict=True):
            raw = blob.as_py()
            stop = 1 + raw[0] * total
            parts.append((unpacked_codes(raw[:stop]), np.frombuffer(zlib.decompress(raw[stop:]), "<u4")))
        _, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        total = np.bincount(back, np.concatenate([k for _, k in parts]))[back]
        level = np.minimum(np.floor(6 * np.log2(total)), 255).astype(np.uint8)
        cuts = np.cumsum([c.size for c, _ in parts])[:-1]
        blobs = [zlib.compress(x.tobytes(), 1) for x in np.split(level, cuts)]
        return pa.Table.from_arrays([group.column("chunk"), group.column("bucket"), group.column("total"), pa.array(blobs, pa.binary())], names=["chunk", "bucket", "total", "blob"])

    return chunks.select("chunk", "blob").mapInArrow(send, CHUNKED).groupBy("bucket").applyInArrow(add, CHUNKED)


def prefixes(chunks: DataFrame, answers: DataFrame, threshold: int) -> DataFrame:
    """``code, n, h, h2``: the codes in each set's prefix that were counted more than once."""

    def run(group):
        buckets = group.column("bucket").to_numpy()
        order = np.argsort(buckets, kind="stable")  # the sets are in bucket -1
        blobs = group.column("blob")
        sets = Sets.load(blobs[int(order[0])].as_py())
        level = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(zlib.decompress(blobs[int(k)].as_py()), np.uint8) for k in order[1:])])
        codes, _ = counted(sets.codes)
        own = np.repeat(np.arange(sets.n.size), sets.many)
        inside = sets.codes < np.uint64(int(COUNTED * 2.0**CODE_BITS))
        key = np.full(sets.codes.size, 1 << 10, np.int64)
        key[inside] = level[np.searchsorted(codes, sets.codes[inside])]
        by = np.lexsort([sets.codes, key, own])
        rank = np.arange(by.size) - np.repeat(np.cumsum(sets.many) - sets.many, sets.many)
        first = by[(rank < prefix_size(sets.n, threshold)[own]) & (key[by] > 0)]
        at = own[first]
        return pa.Table.from_arrays([pa.array(sets.codes[first].astype(np.int64)), pa.array(sets.n[at]), pa.array(sets.h[at]), pa.array(sets.h2[at])], names=["code", "n", "h", "h2"])

    sides = chunks.select("chunk", F.lit(-1).alias("bucket"), F.lit(0).cast("long").alias("total"), "blob").unionByName(answers)
    return sides.groupBy("chunk").applyInArrow(run, "code long, n long, h long, h2 long").distinct()


def bitmap(tokens: np.ndarray, words: int) -> np.ndarray:
    at = (tokens * _STEP) >> np.uint64(32) & np.uint64(64 * words - 1)
    out = np.zeros(words, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


class SignatureTree:
    """Sets ordered by their least shingle, halved down to leaves; nodes hold bitmaps and sizes."""

    LEAF = 8

    def __init__(self, sets: list[np.ndarray], threshold: int):
        self.sets, self.threshold = sets, threshold
        self.least, self.size = np.array([x[0] for x in sets]), np.array([x.size for x in sets])
        self.bits = np.array([bitmap(x, WORDS) for x in sets])
        self.over = self.size - np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        self.forest, self.links = Forest(len(sets)), []

    def node(self, rows: np.ndarray) -> tuple:
        half = rows.size // 2
        below = (self.node(rows[:half]), self.node(rows[half:])) if rows.size > self.LEAF else None
        return rows, np.bitwise_or.reduce(self.bits[rows]), int(self.size[rows].min()), int(self.size[rows].max()), int(self.over[rows].max()), below

    def order(self, rows: np.ndarray) -> np.ndarray:
        return rows[np.argsort(self.least[rows], kind="stable")]

    def among(self, x: tuple) -> None:
        if x[5] is None:
            self.compare(x[0], x[0])
        else:
            self.among(x[5][0])
            self.among(x[5][1])
            self.between(*x[5])

    def between(self, x: tuple, y: tuple) -> None:
        """Dual traversal; a pair needs an overlap of ``threshold`` % of the larger set at least."""
        t = self.threshold
        if 100 * x[3] < t * y[2] or 100 * y[3] < t * x[2]:
            return
        if 100 * (int(np.bitwise_count(x[1] & y[1]).sum()) + min(x[4], y[4])) < t * max(x[2], y[2]):
            return
        root = self.forest.root(int(x[0][0]))
        if all(self.forest.root(int(i)) == root for i in (*x[0], *y[0])):
            return
        if x[5] is None and y[5] is None:
            self.compare(x[0], y[0])
        elif y[5] is None or (x[5] is not None and x[0].size >= y[0].size):
            self.between(x[5][0], y)
            self.between(x[5][1], y)
        else:
            self.between(x, y[5][0])
            self.between(x, y[5][1])

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        most = np.bitwise_count(self.bits[a][:, None] & self.bits[b][None]).sum(2, dtype=np.int64) + np.minimum(self.over[a][:, None], self.over[b][None])
        small, large = np.minimum(self.size[a][:, None], self.size[b][None]), np.maximum(self.size[a][:, None], self.size[b][None])
        may = 100 * np.minimum(most, small) >= self.threshold * large
        for p, q in zip(*np.nonzero(may), strict=True):
            i, j = int(a[p]), int(b[q])
            if i == j or self.forest.root(i) == self.forest.root(j):
                continue
            x, y = self.sets[i], self.sets[j]
            both = x.size + y.size - np.union1d(x, y).size
            if 100 * both >= self.threshold * (x.size + y.size - both):
                self.forest.join(i, j)
                self.links.append((i, j))


def may_hold(docs: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``doc_id, text_key, text`` of all rows whose keys are in ``wanted``, and of few others: it
    spares the texts of most other rows the shuffle of the join that follows."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), common.texts().alias("text"))
    return Filter(wanted, keys).marked(rows, "may").filter("may").select("doc_id", "text_key", "text")


def verified(deals: DataFrame, docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """Links ``a, b`` (``sid``) of ``doc_id, sid, h, h2, deals``: one row a set, with the tasks and the
    sides in them that it goes to.  In a task, sets of unlike sides are compared, or all if one side
    is empty, and those that are in one component already (``comp``) are not."""
    dealt = may_hold(docs, deals, ["doc_id"]).join(deals, "doc_id").select("text", "sid", "h", "h2", "comp", "deals")

    def send(batches):
        for batch in batches:
            rows, held = [], 0
            sid, h, h2, comp = (batch.column(k).to_pylist() for k in range(1, 5))
            for k, tokens in shingle_sets(batch.column(0), width):
                # repeated rows of an id may hold other texts: the set's hashes tell them apart
                if tokens.size and set_hashes(tokens) == (h[k], h2[k]):
                    blob = tokens.tobytes()
                    for d in batch.column(5)[k].as_py():
                        rows.append((d["task"], d["side"], sid[k], comp[k], blob))
                        held += len(blob)
                        if held > common.GROUP_BYTES:
                            yield packed(rows)
                            rows, held = [], 0
            yield packed(rows)
        pa.default_memory_pool().release_unused()

    def packed(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], ["task", "side", "sid", "comp", "blob"])

    def tree(group):
        _, one = np.unique(group.column("sid").to_numpy(), return_index=True)
        group = group.take(pa.array(one))
        names, side, comp = (group.column(c).to_numpy() for c in ("sid", "side", "comp"))
        t = SignatureTree([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("blob")], threshold)
        first: dict[int, int] = {}
        for i, c in enumerate(comp.tolist()):
            t.forest.join(first.setdefault(c, i), i)
        rows = [t.order(np.flatnonzero(side == s)) for s in (0, 1)]
        if rows[0].size and rows[1].size:
            t.between(t.node(rows[0]), t.node(rows[1]))
        elif rows[0].size:
            t.among(t.node(rows[0]))
        return pa.Table.from_arrays([pa.array([int(names[i]) for i, _ in t.links], pa.int64()), pa.array([int(names[j]) for _, j in t.links], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(send, "task long, side int, sid long, comp long, blob binary").groupBy("task").applyInArrow(tree, "a long, b long")


def leaf_deals(least: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """Deals each set to one group in each round: those with the same least code under the round's
    hash (``least``: ``sid, k0, k1, ...``), cut by a hash of the set where they are more than ``block``."""
    keys = F.explode(F.array(*(F.struct(F.lit(r).alias("round"), F.col(f"k{r}").alias("key")) for r in range(ROUNDS))))
    each = common.keep(least.select("sid", keys.alias("r")).select("sid", "r.*"))
    many = each.groupBy("round", "key").agg(F.count("*").alias("many")).filter("many > 1")
    part = F.pmod(F.xxhash64("sid", "round"), F.ceil(F.col("many") / block))
    placed = join_hot(each, many, ["round", "key"], "many").withColumn("task", F.xxhash64("round", "key", part))
    deals = placed.groupBy("sid").agg(F.collect_list(F.struct("task", F.lit(0).alias("side"))).alias("deals"))  # ROUNDS at most
    deals = common.keep(deals.join(members, "sid").withColumn("comp", F.col("sid")).select("doc_id", "sid", "h", "h2", "comp", "deals"))
    common.discard(each)
    return deals


def sampled_bases(picked: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``key, size, codes, counts``: of the ``size`` sets picked from a group, the codes that at least two
    hold, and how many do.  ``picked``: ``doc_id, sid, h, h2, key``."""
    texts = may_hold(docs, picked, ["doc_id"]).join(picked, "doc_id").select("text", "sid", "h", "h2", "key")

    def send(batches):
        for batch in batches:
            sid, h, h2, key = (batch.column(k).to_pylist() for k in range(1, 5))
            for k, tokens in shingle_sets(batch.column(0), width):
                if tokens.size and set_hashes(tokens) == (h[k], h2[k]):
                    yield pa.RecordBatch.from_arrays([pa.array([key[k]], pa.int64()), pa.array([sid[k]], pa.int64()), pa.array([tokens.tobytes()], pa.binary())], ["key", "sid", "blob"])

    def add(key, group):
        _, one = np.unique(group.column("sid").to_numpy(), return_index=True)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.take(pa.array(one)).column("blob")]
        codes, count = np.unique(np.concatenate(sets), return_counts=True)
        codes, count = codes[count > 1], count[count > 1].astype(np.int32)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([len(sets)], pa.int32()), pa.array([codes.tobytes()], pa.binary()), pa.array([count.tobytes()], pa.binary())], names=["key", "size", "codes", "counts"])

    return texts.mapInArrow(send, "key long, sid long, blob binary").groupBy("key").applyInArrow(add, "key long, size int, codes binary, counts binary")


def difference(tokens: np.ndarray, size: int, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The codes in which a set and the base (codes that over half of the sampled sets hold) differ,
    those first that the fewest sampled sets have in theirs; an order that all sets of a group share."""
    base = codes[2 * counts > size]
    own, gone = np.setdiff1d(tokens, base, assume_unique=True), np.setdiff1d(base, tokens, assume_unique=True)
    both, often = np.concatenate([own, gone]), np.zeros(own.size + gone.size, np.int64)
    if codes.size:
        at = np.minimum(np.searchsorted(codes, both), codes.size - 1)
        often = np.where(codes[at] == both, counts[at], 0)
        often[own.size :] = size - often[own.size :]
    return both[np.lexsort([both, often])]


def differences(large: DataFrame, bases: DataFrame, docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """``key, sid, n, d, slack, codes``: for each set of a large group the number of codes in which it
    differs from its group's base, and as many of them as a prefix may take.

    With ``D`` for these differences, two sets differ in ``|D(x) ^ D(y)|`` codes, and they link when
    ``(100 + t) |D(x) ^ D(y)| <= (100 - t) (n(x) + n(y))``.  ``slack = (100 - t) n - (100 + t) d``."""
    parts = F.greatest(F.ceil(F.col("many") / 1024), F.lit(1))
    rows = may_hold(docs, large, ["doc_id"]).join(large, "doc_id").withColumn("part", F.pmod(F.xxhash64("sid"), parts))
    # one copy of a base for each 1,024 sets, so that no group gathers in one task of the join
    spread = bases.join(large.select("key", "many").distinct(), "key").select("key", "size", "codes", "counts", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    dealt = rows.join(spread, ["key", "part"], "left").select("text", "h", "h2", "key", "sid", "size", "codes", "counts")

    def run(batches):
        at, base = None, None
        for batch in batches:
            h, h2, key, sid = (batch.column(k).to_pylist() for k in range(1, 5))
            out = []
            for k, tokens in shingle_sets(batch.column(0), width):
                if not tokens.size or set_hashes(tokens) != (h[k], h2[k]):
                    continue
                if at != key[k]:
                    blobs = [b"" if (x := batch.column(c)[k].as_py()) is None else x for c in (6, 7)]
                    at, base = key[k], (batch.column(5)[k].as_py() or 0, np.frombuffer(blobs[0], np.uint64), np.frombuffer(blobs[1], np.int32))
                d = difference(tokens, *base)
                most = (100 - threshold) * tokens.size // threshold + 1
                out.append((key[k], sid[k], tokens.size, d.size, (100 - threshold) * tokens.size - (100 + threshold) * d.size, d[:most].astype(np.int64)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (*[pa.int64()] * 5, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["key", "sid", "n", "d", "slack", "codes"])

    # a set may come from several rows of an id and from other partitions: one is enough
    return dealt.mapInArrow(run, "key long, sid long, n long, d long, slack long, codes array<long>").dropDuplicates(["key", "sid"])


def open_groups(left: DataFrame, members: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Sets that share a code of ``left`` (``code, sid, comp, most``) share a group, that of the code's
    ``most``.  Returns the sets of groups of up to ``4 * block`` (and of 2^21 codes), and of others."""
    groups = left.select(F.col("most").alias("key"), "sid", "comp").distinct().join(members, "sid")
    groups = common.keep(groups)
    sized = groups.groupBy("key").agg(F.count("*").alias("many"), F.sum("n").alias("weight"))
    tagged = common.keep(join_hot(groups, common.keep(sized), ["key"], "many"))
    is_small = (F.col("many") <= 4 * block) & (F.col("weight") <= 1 << 21)
    return tagged.filter(is_small), tagged.filter(~is_small)


def certain_links(diffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, top, star, many`` of each group, and links ``a, b`` to the set of most slack.

    Two sets whose slacks add up to no less than 0 link whatever their differences are; then both
    link to the set of most slack, so these links join all that such pairs join."""
    stars = common.keep(diffs.groupBy("key").agg(F.max("slack").alias("top"), F.max_by("sid", F.struct("slack", "sid")).alias("star"), F.count("*").alias("many")))
    sure = join_hot(diffs.select("key", "sid", "slack"), stars, ["key"], "many").filter("slack + top >= 0 and sid <> star")
    return stars, common.keep(sure.select(F.col("sid").alias("a"), F.col("star").alias("b")).distinct())


def difference_deals(diffs: DataFrame, stars: DataFrame, comps: DataFrame, threshold: int, part: int = 512) -> DataFrame:
    """``sid, task, side``: deals sets of large groups to tasks, by codes of their differences.

    Slacks of any other pair add up to less than 0, so it can only link if its differences share a code.
    The first shared code in the common order has in front of it, in each set, only codes that the
    other set's differences lack: at most ``(100 - t) n / (100 + t)`` in the set of more slack, and in
    the other ``((100 - t) n + (100 + t) d + top) / 2 (100 + t)``, and ``(100 - t) n / t`` in any."""
    t = threshold
    high = F.floor((100 - t) * F.col("n") / (100 + t)) + 1
    low = F.least(F.floor((100 - t) * F.col("n") / t), F.floor(((100 - t) * F.col("n") + (100 + t) * F.col("d") + F.col("top")) / (2 * (100 + t)))) + 1
    cut = join_hot(diffs, stars, ["key"], "many").filter(low > 0)
    each = cut.select("key", "sid", high.alias("high"), F.posexplode(F.slice("codes", F.lit(1), low.cast("int"))).alias("pos", "code"))
    posts = common.keep(each.select("key", "sid", "code", (F.col("pos") < F.col("high")).alias("high")).join(comps, "sid"))
    lists = posts.groupBy("key", "code").agg(F.count("*").alias("many"), F.bit_xor(F.xxhash64("sid")).alias("sids"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.max("high").alias("any"))
    lists = common.keep(lists.filter("least < most and any").select("key", "code", "many", "sids"))
    # codes with the same sets are one task
    placed = join_hot(posts.select("key", "code", "sid"), lists, ["key", "code"], "many").select("sid", F.xxhash64("key", "many", "sids").alias("list"), F.ceil(F.col("many") / part).alias("parts")).distinct()
    own = F.pmod(F.xxhash64("sid"), F.col("parts"))
    pairs = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    out = common.keep(pairs.select("sid", F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other")).alias("task"), (F.col("own") > F.col("other")).cast("int").alias("side")))
    common.discard(posts, lists)
    return out


def open_links(left: DataFrame, members: DataFrame, docs: DataFrame, threshold: int, width: int, block: int) -> DataFrame:
    """Links ``a, b`` between sets of unlike components that share a code of ``left``."""
    small, large = open_groups(left, members, block)
    # each code of a set may name another group; their number is that of its open codes at most
    deals = small.select("sid", F.xxhash64("key").alias("task"), F.lit(0).alias("side"))
    known = small.select("sid", "doc_id", "h", "h2", "comp").distinct()
    if large.isEmpty():
        return verified(_listed(deals, known), docs, threshold, width)
    picked = common.keep(large.filter(F.pmod(F.xxhash64(F.lit(1), "sid"), F.greatest(F.ceil(F.col("many") / block), F.lit(1))) == 0).select("doc_id", "sid", "h", "h2", "key"))
    bases = common.keep(sampled_bases(picked, docs, width))
    diffs = common.keep(differences(large.select("doc_id", "sid", "h", "h2", "key", "many"), bases, docs, threshold, width))
    stars, sure = certain_links(diffs)
    known = common.keep(known.unionByName(large.select("sid", "doc_id", "h", "h2", "comp")).distinct())
    # components that the certain links join are one from here on
    named = known.select("sid", "comp")
    ends = sure.join(named.select(F.col("sid").alias("a"), F.col("comp").alias("x")), "a").join(named.select(F.col("sid").alias("b"), F.col("comp").alias("y")), "b")
    joined = common.keep(components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("comp"), "component"))
    known = common.keep(known.join(joined, "comp", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component"))
    more = difference_deals(diffs, stars, known.select("sid", "comp"), threshold)
    found = verified(_listed(deals.unionByName(more), known), docs, threshold, width)
    return found.unionByName(sure)


def _listed(deals: DataFrame, known: DataFrame) -> DataFrame:
    """Deals of each set as one array, beside what ``verified`` needs."""
    lists = deals.groupBy("sid").agg(F.collect_set(F.struct("task", "side")).alias("deals"))
    return common.keep(lists.join(known, "sid").select("doc_id", "sid", "h", "h2", "comp", "deals"))


def near_duplicates(docs: DataFrame, threshold: int = 80, width: int = 5, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_key, text_key`` of each row of ``doc_id, text``;
    threshold in %.  Rows share a ``class_key`` if they are copies or reach each other by links; it is
    null where a row is alone in its class."""
    again = common.keep(copies(docs))
    known = Filter(again, ["doc_id", "text_key"])
    described = common.keep(describe(docs, known, threshold, width))
    rows = described.filter(F.col("chunk").isNull()).select("doc_id", "text_key", "n", "h", "h2")
    # rows that the bitmap took for copies and that are none
    others = may_hold(docs, again, ["doc_id", "text_key"]).join(again.distinct(), ["doc_id", "text_key"], "left_anti")
    more = common.keep(describe(others, None, threshold, width).filter(F.col("chunk").isNotNull()).withColumn("chunk", -1 - F.col("chunk")))
    chunks = described.filter(F.col("chunk").isNotNull()).unionByName(more)
    buckets = max(1, -(-(chunks.agg(F.sum("n")).first()[0] or 0) // BUCKET))
    found = rows.filter("n > 0").groupBy("h", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count("*").alias("copies"))
    reps = common.keep(found.withColumn("sid", F.monotonically_increasing_id()))
    answers = common.keep(levels(chunks, buckets))
    raw = common.keep(prefixes(chunks, answers, threshold))
    posts = common.keep(raw.join(reps.filter(F.col("doc_id").isNotNull()).select("h", "h2", "sid"), ["h", "h2"]).select("code", "sid"))
    common.discard(answers, raw, again, more)
    members = reps.select("sid", "doc_id", "h", "h2", "n")
    least = common.keep(posts.groupBy("sid").agg(*(F.min(F.xxhash64(F.lit(r), "code")).alias(f"k{r}") for r in range(ROUNDS))))
    dealt = leaf_deals(least, members, block)
    near = common.keep(verified(dealt, docs, threshold, width))
    common.discard(dealt)
    # codes whose sets are not one component yet
    comps = common.keep(components(near).select(F.col("node").alias("sid"), F.col("component").alias("comp")))
    common.discard(near)
    named = posts.join(comps, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    per = named.groupBy("code", "comp").agg(F.count("*").alias("many"))
    most = F.max_by("comp", F.struct("many", "comp")).alias("most")  # the component with most sets
    still = per.groupBy("code").agg(F.count("*").alias("comps"), most, F.sum("many").alias("total")).filter("comps > 1")
    still = common.keep(still.select("code", "most", "total"))
    left = common.keep(join_hot(named, still, ["code"], "total").select("code", "sid", "comp", "most"))
    last = common.keep(open_links(left, members, docs, threshold, width, block))
    common.discard(posts, least, still, left)
    # the second round's links, between the first one's components
    to = comps.select(F.col("sid").alias("a"), F.col("comp").alias("x"))
    both = last.join(to, "a", "left").join(to.select(F.col("a").alias("b"), F.col("x").alias("y")), "b", "left")
    above = components(both.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    sets = reps.join(comps, "sid", "left").withColumn("node", F.coalesce("comp", "sid")).join(above, "node", "left").withColumn("class_key", F.coalesce("component", "node"))
    sets = common.keep(sets.select("h", "h2", "doc_id", "copies", "class_key"))
    classes = sets.groupBy("class_key").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("many")).filter("many > 1")
    known = common.keep(join_hot(sets, classes, ["class_key"], "many").select("h", "h2", "copies", "class_key", "component_id"))
    common.discard(comps, last, sets)
    # only sets with copies or links have another class than their own row's id
    out = join_hot(rows, known, ["h", "h2"], "copies", how="left")
    own = F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), "class_key", "text_key")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
