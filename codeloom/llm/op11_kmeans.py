"""Operator 11: centroid clustering by sort-means, in exact integers.

Each round orders the other centroids by their distance from each centroid.  A vector is measured
against the centroid of its previous assignment first, at distance d, and then against the others in
that centroid's order, up to the first that is strictly further than 2 d from it: by the triangle
inequality none behind it is nearer or as near.  (d stays the distance from the previous centroid; a
bound that shrank with the best so far would not be safe.)  Ties go to the smaller number.

Vectors are packed once into blocks of ``BLOCK`` and written as a table bucketed by block.  A round
reads it beside the blocks' assignments (four bytes a vector), joined on the bucketing, so that only
assignments are shuffled, and writes new assignments and its tasks' sums.  Sums are added by Spark;
the driver gets one row for each centroid, component and limb, which the parameters bound, never
vectors.

Components become ``floor(scale * x)`` as whole numbers of any size.  Blocks below ``SMALL`` are
worked on in double, where every sum stays below 2^53; others in Python's integers, by limbs of 30
bits.  A squared distance beyond 64 bits is null, and so are the sums it is part of.

Vectors that are null, have another length or hold null or non-finite components take no part.  Null
ids are hashed as empty ones.  Rows that repeat an id are vectors of their own; of such, the first
centroids take the one that is least by its components.  Fewer vectors than ``k``: as many clusters.
An empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import common

BLOCK = 128
SMALL = 1 << 22
LIMB = 30
BUCKET_VECTORS = 1 << 18
OUTPUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def small_limit(dim: int) -> int:
    """Components below it have sums of squared differences, and four times these, exact in double."""
    return min(SMALL, math.isqrt((1 << 51) // max(dim, 1)) // 2)


def whole(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) >= 2.0**52 else math.floor(x * scale)


def matrix(rows: list[list[int]], dim: int) -> np.ndarray:
    """Double where that is exact, else Python's integers."""
    limit = small_limit(dim)
    if all(abs(v) < limit for row in rows for v in row):
        return np.array(rows, np.float64).reshape(len(rows), dim)
    return np.array([[int(v) for v in row] for row in rows], object).reshape(len(rows), dim)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(1)


class Centroids:
    """Centroids of a round, with the others of each in the order of their distance from it."""

    def __init__(self, rows: list[list[int]], dim: int):
        self.rows, self.x = rows, matrix(rows, dim)
        gaps = [squared(self.x, c) for c in self.x]
        self.order = [np.argsort(g, kind="stable") for g in gaps]
        self.order = [o[o != c] for c, o in enumerate(self.order)]
        self.gaps = [g[o] for g, o in zip(gaps, self.order, strict=True)]

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and squared distance of each vector, and how many distances that took."""
        c = self.x
        if x.dtype != c.dtype:
            x, c = as_ints(x), as_ints(c)
        own = squared(x, c[before])
        best, least, measured = before.copy(), own.copy(), x.shape[0]
        for p in np.unique(before).tolist():
            rows = np.flatnonzero(before == p)
            rows = rows[np.argsort(-own[rows], kind="stable")]
            reach = 4 * own[rows]  # descending: those that a centroid can still serve come first
            for other, gap in zip(self.order[p].tolist(), self.gaps[p].tolist(), strict=True):
                rows = rows[: int(np.count_nonzero(reach[: rows.size] >= gap))]
                if not rows.size:
                    break
                d = squared(x[rows], c[other])
                measured += rows.size
                nearer = ((d < least[rows]) | ((d == least[rows]) & (other < best[rows]))).astype(bool)
                best[rows[nearer]], least[rows[nearer]] = other, d[nearer]
        return best, least, measured


def as_ints(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def packed(df: DataFrame, dim: int, scale: int) -> DataFrame:
    """Blocks of vectors of ``vec_id, x`` (doubles): 32-bit integers, or text where they are larger."""

    def run(batches):
        part, n, limit = TaskContext.get().partitionId(), 0, small_limit(dim)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            x = batch.column(1).combine_chunks() if isinstance(batch.column(1), pa.ChunkedArray) else batch.column(1)
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            small = (np.abs(x) < limit / scale).all(1)
            out = []
            for wide, rows in ((False, np.flatnonzero(small)), (True, np.flatnonzero(~small))):
                for lo in range(0, rows.size, BLOCK):
                    mine = rows[lo : lo + BLOCK]
                    if wide:
                        data = " ".join(str(whole(v, scale)) for v in x[mine].ravel().tolist()).encode()
                    else:
                        data = np.floor(x[mine] * scale).astype("<i4").tobytes()
                    out.append((part << 40 | n, wide, mine.size, [ids[i] for i in mine.tolist()], data))
                    n += 1
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["block", "wide", "many", "ids", "data"])

    return df.mapInArrow(run, "block long, wide boolean, many int, ids array<long>, data binary")


def blocks_of(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """Rows of a batch by kind, and their vectors."""
    wide = batch.column("wide").to_pylist()
    data = batch.column("data")
    for kind in (False, True):
        rows = [i for i, w in enumerate(wide) if w == kind]
        if not rows:
            continue
        if kind:
            x = np.array([int(v) for i in rows for v in data[i].as_py().split()], object).reshape(-1, dim)
        else:
            x = np.frombuffer(b"".join(data[i].as_py() for i in rows), "<i4").reshape(-1, dim).astype(np.float64)
        yield rows, x


class Sums:
    """Exact sums of a task's vectors for each centroid."""

    def __init__(self, k: int, dim: int):
        self.many, self.small = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        self.wide: dict[int, np.ndarray] = {}

    def add(self, x: np.ndarray, to: np.ndarray) -> None:
        order = np.argsort(to, kind="stable")
        found, starts = np.unique(to[order], return_index=True)
        self.many += np.bincount(to, minlength=self.many.size)
        if x.dtype != object:
            self.small[found] += np.add.reduceat(x[order].astype(np.int64), starts)
            return
        for c, rows in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
            self.wide[c] = x[rows].sum(0) + self.wide.get(c, 0)

    def rows(self) -> list[tuple[int, int, int, int]]:
        """Centroid, component (-1: the count), limb, value."""
        out = []
        for c in np.flatnonzero(self.many).tolist():
            out.append((c, -1, 0, int(self.many[c])))
            out += [(c, j, 0, v) for j, v in enumerate(self.small[c].tolist()) if v]
            for j, v in enumerate(self.wide[c].tolist() if c in self.wide else ()):
                limb = 0
                while v not in (0, -1):
                    out.append((c, j, limb, v & ((1 << LIMB) - 1)))
                    v, limb = v >> LIMB, limb + 1
                if v:
                    out.append((c, j, limb, v))
        return out


def _round(now: Centroids, k: int, dim: int):
    """New assignments of the blocks, and behind them the task's sums."""
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    names = ["block", "assigned", "cluster", "component", "limb", "value"]

    def run(batches):
        sums = Sums(k, dim)
        for batch in batches:
            out: list[tuple] = []
            for rows, x in blocks_of(batch, dim):
                best, _, _ = now.assign(x, previous(batch, rows))
                sums.add(x, best)
                at = 0
                for i in rows:
                    n = batch.column("many")[i].as_py()
                    out.append((batch.column("block")[i].as_py(), best[at : at + n].astype("<u4").tobytes()))
                    at += n
            columns = zip(*out, strict=True) if out else [[]] * 2
            arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds[:2], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.nulls(len(out), t) for t in kinds[2:]], names)
        found = sums.rows()
        columns = zip(*found, strict=True) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.nulls(len(found), t) for t in kinds[:2]] + [pa.array(list(c), t) for c, t in zip(columns, kinds[2:], strict=True)], names)

    return run


def previous(batch: pa.RecordBatch, rows: list[int]) -> np.ndarray:
    """Earlier assignments of the rows' vectors; the first centroid in the first round."""
    held, many = batch.column("assigned"), batch.column("many")
    return np.concatenate([np.frombuffer(held[i].as_py(), "<u4").astype(np.int64) if held[i].is_valid else np.zeros(many[i].as_py(), np.int64) for i in rows])


def _last(now: Centroids, dim: int):
    kinds = (pa.int64(), pa.int32(), pa.int64())

    def run(batches):
        for batch in batches:
            ids: list[int | None] = []
            to: list[int] = []
            far: list[int | None] = []
            for rows, x in blocks_of(batch, dim):
                best, least, _ = now.assign(x, previous(batch, rows))
                ids += [v for i in rows for v in batch.column("ids")[i].as_py()]
                to += best.tolist()
                far += [d if (d := int(v)) < 1 << 63 else None for v in least.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, to, far), kinds, strict=True)], ["vec_id", "cluster", "distance"])

    return run


def moved(now: list[list[int]], sums: list) -> list[list[int]]:
    """Centroids as the floor of their vectors' means; those without vectors stay."""
    many: dict[int, int] = {}
    total: dict[tuple[int, int], int] = {}
    for c, j, limb, value in sums:
        if j < 0:
            many[c] = int(value)
        else:
            total[c, j] = total.get((c, j), 0) + (int(value) << (LIMB * limb))
    return [[total.get((c, j), 0) // many[c] for j in range(len(row))] if c in many else row for c, row in enumerate(now)]


def usable(df: DataFrame, id_col: str, vector: str, dim: int) -> DataFrame:
    """``vec_id, x`` of the vectors that take part, as doubles."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    return rows.filter((F.size("x") == dim) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` after ``rounds``."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector, dim)
    named = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.withColumn("named", named).orderBy("named", "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], OUTPUT)
    now = [[whole(v, scale) for v in r.x] for r in first]

    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // BUCKET_VECTORS))
    name = f"codeloom_blocks_{uuid.uuid4().hex}"
    at = f"{common.shared_folder(spark)}/{name}"
    packed(rows, dim, scale).repartition(parts, "block").write.bucketBy(parts, "block").option("path", at).format("parquet").saveAsTable(name)
    blocks, held = spark.table(name), None
    try:
        for _ in range(rounds):
            step = common.keep(_beside(blocks.drop("ids"), held).mapInArrow(_round(Centroids(now, dim), len(now), dim), "block long, assigned binary, cluster int, component int, limb int, value long"))
            if held is not None:
                common.discard(held)
            held = step
            now = moved(now, held.filter("cluster IS NOT NULL").groupBy("cluster", "component", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect())
        out = common.keep(_beside(blocks, held).mapInArrow(_last(Centroids(now, dim), dim), "vec_id long, cluster int, distance long"))
        if held is not None:
            common.discard(held)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        blocks.kept_at = at
        common.discard(blocks)
    whole_sum = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r.cluster: None if r.total is None else int(r.total) for r in out.groupBy("cluster").agg(whole_sum.alias("total")).collect()}  # k rows at most
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    everything = fits(None if None in sums.values() else sum(sums.values()))
    ends = [(c, fits(total), everything, hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for c, total in sums.items()]
    return out.join(F.broadcast(spark.createDataFrame(ends, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _beside(blocks: DataFrame, held: DataFrame | None) -> DataFrame:
    """Blocks with their assignments.  The blocks lie bucketed, so only the assignments move."""
    if held is None:
        return blocks.withColumn("assigned", F.lit(None).cast("binary"))
    return blocks.join(held.filter("block IS NOT NULL").select("block", "assigned").hint("shuffle_hash"), "block")


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(common.table(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10) -> str:
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda c: CAST(floor(1024 * c::DOUBLE) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256(concat('3:', vec_id)), embedding) - 1 AS INTEGER) AS c, x FROM v ORDER BY c LIMIT {k})",
    ]
    for n in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, c.c, CAST({distance} AS BIGINT) AS d FROM v, c{n} AS c) AS p GROUP BY r)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT c, i, sum(y) AS s, count(*) AS n FROM (SELECT a.c, generate_subscripts(v.x, 1) AS i, unnest(v.x) AS y FROM v JOIN a{n} AS a ON a.r = v.r) AS u GROUP BY c, i)")
            parts.append(f"m{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{n} GROUP BY c)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{n} AS c LEFT JOIN m{n} AS m ON m.c = c.c)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN v ON v.r = a.r JOIN c{rounds} AS c ON c.c = a.c"""


SQL = _sql()
