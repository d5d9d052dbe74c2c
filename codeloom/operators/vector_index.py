"""Approximate nearest neighbours by an inverted file.

Unit vectors are clustered into cells (Spark's k-means, on a bounded sample: ``PER_CELL`` vectors a
cell at most, chosen by a hash of the key); every vector is assigned to the cell of its nearest
centroid, and the table is laid out by cell, so that a search opens the folders of the few cells
nearest to its query and ranks what is in them by exact cosine.  How many cells that takes depends on
the vectors: ``calibrate`` asks a bounded number of stored vectors, searches exactly, and gives the
least number of cells that hold ``TARGET`` of the true neighbours.  ``probes=None`` searches all cells,
which is the exact search.  Vectors that are null, of another length or without direction lie in cell
-1, which has no centroid: only an exact search sees them.

The centroids are ``MOST_CELLS`` rows at most, whatever the number of vectors, so they may be held by
the driver and sent to tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions import similarity
from codeloom.operators import retrieval

MOST_CELLS, PER_CELL, LEAST, ROUNDS, SEED = 4096, 256, 1024, 10, 17
TARGET, ASKED = 0.95, 64
#: Vectors of a block, queries that meet one at a time, and how far a matrix product may be off.
BLOCK, SLICE, MARGIN = 16_384, 64, 1e-9


def cells_for(n: int) -> int:
    """About the root of ``n``, but none of fewer than ``LEAST`` vectors on average."""
    return max(1, min(MOST_CELLS, math.isqrt(n), n // LEAST))


def directed(embedding: Column, size: int) -> Column:
    """Whether a vector has this length and a direction."""
    whole = F.aggregate(embedding, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double") * x.cast("double"), F.lit(float("nan"))))
    return F.coalesce((F.size(embedding) == size) & ~F.isnan(whole) & (whole > 0) & (whole < float("inf")), F.lit(False))


def unit(embedding: Column) -> Column:
    norm = F.sqrt(similarity.dot(embedding, embedding))
    # repeated as an array: within a lambda it would be worked out for each component
    return F.zip_with(embedding, F.array_repeat(norm, F.size(embedding)), lambda x, n: x.cast("double") / n)


def train(vectors: DataFrame, key: str, embedding: str, size: int, cells: int | None = None) -> list[list[float]]:
    """Centroids of unit vectors, in an order of their own; none where no vector has a direction."""
    usable = vectors.filter(directed(F.col(embedding), size))
    n = usable.count()
    if not n:
        return []
    k = min(cells or cells_for(n), n)
    if k == 1:
        means = usable.select(F.posexplode(unit(F.col(embedding)))).groupBy("pos").agg(F.avg("col").alias("mean"))
        return [[r.mean for r in means.orderBy("pos").collect()]]
    share = min(1.0, k * PER_CELL / n)
    # a hash of the key, so that the same rows are chosen at every run
    sample = usable.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    rows = sample.select(array_to_vector(unit(F.col(embedding))).alias("features"))
    model = KMeans(k=k, maxIter=ROUNDS, seed=SEED, featuresCol="features").fit(rows)
    found = [(c / norm).tolist() for c in model.clusterCenters() if (norm := float(np.sqrt((c * c).sum()))) > 0]
    return sorted(found)


def assign(vectors: DataFrame, embedding: str, centroids: list[list[float]]) -> DataFrame:
    """Adds ``cell``: the number of the centroid with the largest cosine, the least of equal ones."""
    held = np.array(centroids, np.float64)
    if not len(centroids):
        return vectors.withColumn("cell", F.lit(-1))
    size = held.shape[1]
    if len(centroids) == 1:
        return vectors.withColumn("cell", F.when(directed(F.col(embedding), size), 0).otherwise(-1))

    @F.pandas_udf("int")
    def cell(rows: pd.Series) -> pd.Series:
        ok = [r is not None and len(r) == size for r in rows]
        x = np.array([r if fine else np.zeros(size) for r, fine in zip(rows, ok, strict=True)], np.float64).reshape(-1, size)
        x = np.where(np.isfinite(x).all(1, keepdims=True), x, 0.0)
        return pd.Series(np.where((x != 0).any(1), (x @ held.T).argmax(1), -1).astype("int32"))

    return vectors.withColumn("cell", cell(F.col(embedding).cast("array<double>")))


def nearest_cells(centroids: list[list[float]], query: list[float], probes: int) -> list[int]:
    held, q = np.array(centroids, np.float64), np.array(query, np.float64)
    if not len(centroids) or held.shape[1] != q.size:
        return []
    return np.argsort(-(held @ q), kind="stable")[:probes].tolist()


def build(vectors: DataFrame, key: str, embedding: str, size: int, at: str, cells: int | None = None) -> list[list[float]]:
    """Writes the vectors to ``at`` in a folder for each cell; the centroids.  Large cells are split
    over tasks, small ones written together."""
    centroids = train(vectors, key, embedding, size, cells)
    assign(vectors, embedding, centroids).hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(at)
    return centroids


def calibrate(index: DataFrame, centroids: list[list[float]], key: str, embedding: str, limit: int = retrieval.VECTOR, target: float = TARGET, asked: int = ASKED) -> int:
    """The least number of probes whose recall is ``target`` for ``asked`` stored vectors, chosen by a
    hash of the key.  The driver gets ``asked`` x ``limit`` rows."""
    if len(centroids) < 2:
        return 1
    chosen = index.filter("cell >= 0").orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(SEED)), key).limit(asked)
    queries = chosen.select(F.col(key).alias("query_id"), F.col(embedding).alias("query"))
    order = {r.query_id: nearest_cells(centroids, r.query, len(centroids)) for r in queries.collect()}
    deep = sorted(order[r.query_id].index(r.cell) for r in search_many(index, centroids, queries, key, embedding, limit).collect())
    return 1 + deep[math.ceil(target * len(deep)) - 1] if deep else 1


def search(index: DataFrame, centroids: list[list[float]], key: str, embedding: str, query: list[float], limit: int = retrieval.VECTOR, probes: int | None = None, where: Column | None = None) -> DataFrame:
    """``key, score`` of the nearest vectors in the ``probes`` nearest cells; in all where that is None."""
    if probes is not None:
        index = index.filter(F.col("cell").isin(nearest_cells(centroids, query, probes)))  # a partition filter
    return retrieval.nearest(index, key, embedding, query, limit, where)


def search_many(index: DataFrame, centroids: list[list[float]], queries: DataFrame, key: str, embedding: str, limit: int = retrieval.VECTOR, probes: int | None = None) -> DataFrame:
    """``query_id, key, cell, score, rank`` for a set of ``query_id, query``; a query does not find its
    own key, nor vectors without direction, and one without direction finds nothing.

    The vectors of a cell (of all cells, where every one is probed) are dealt into blocks of about
    ``BLOCK``; the queries travel to the blocks that they probe and leave each with ``limit`` rows, so
    that no pair is ever a row.  A task holds one block and a slice of the queries."""
    size = len(centroids[0]) if len(centroids) else 0
    held = np.array(centroids, np.float64)
    usable = index.filter(directed(F.col(embedding), size))
    place = F.lit(0) if probes is None else F.col("cell")
    counts = {r.place__: r.n for r in usable.groupBy(place.alias("place__")).agg(F.count("*").alias("n")).collect()}  # MOST_CELLS rows at most
    first, blocks = {}, 0
    for c in sorted(counts):
        first[c], blocks = blocks, blocks + -(-counts[c] // BLOCK)
    ends = {c: first[c] + -(-counts[c] // BLOCK) for c in counts}

    @F.pandas_udf("array<int>")
    def asks(rows: pd.Series) -> pd.Series:
        near = [[0] if probes is None else np.argsort(-(held @ np.array(r, np.float64)), kind="stable")[:probes].tolist() for r in rows]
        return pd.Series([[b for c in cells if c in first for b in range(first[c], ends[c])] for cells in near])

    dealt = index.sparkSession.createDataFrame([(c, first[c], ends[c] - first[c]) for c in first], "place__ int, first__ int, parts__ int")
    stored = usable.withColumn("place__", place).join(F.broadcast(dealt), "place__")
    block = (F.col("first__") + F.pmod(F.xxhash64(F.col(key).cast("string")), F.col("parts__"))).cast("int").alias("block")
    types = index.schema[key].dataType, queries.schema["query_id"].dataType
    # floats travel as floats: half the bytes, and the same doubles
    floats = all(df.schema[c].dataType == T.ArrayType(T.FloatType(), df.schema[c].dataType.containsNull) for df, c in ((index, embedding), (queries, "query")))
    numbers = "array<float>" if floats else "array<double>"
    rows = stored.select(block, F.lit(0).alias("side"), F.col(key).alias("id"), F.lit(None).cast(types[1]).alias("query_id"), F.col("cell").cast("int").alias("cell"), F.col(embedding).cast(numbers).alias("x"))
    asked = queries.filter(directed(F.col("query"), size)).select(F.explode(asks(F.col("query").cast("array<double>"))).alias("block"), F.lit(1), F.lit(None).cast(types[0]), "query_id", F.lit(None).cast("int"), F.col("query").cast(numbers))
    met = rows.union(asked).repartition(max(1, min(blocks, MOST_CELLS)), "block").sortWithinPartitions("block", "side")
    schema = T.StructType([T.StructField("query_id", types[1]), T.StructField(key, types[0]), T.StructField("cell", T.IntegerType()), T.StructField("score", T.DoubleType())])
    scored = met.mapInArrow(_nearest_in_block(size, limit, key), schema)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", order).filter(F.col("rank") <= limit)


def _units(x: pa.Array, size: int) -> np.ndarray:
    """Rows at length 1, by the same additions in the same order as ``unit``."""
    rows = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return rows / np.sqrt(_dots(rows, rows))[:, None]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, by the same additions in the same order as ``similarity.dot``."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _best(x: np.ndarray, order: np.ndarray, q: np.ndarray, own: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q``, of ``x`` and scores of the ``limit`` nearest; ``order``: the keys' order, ``own``: the
    place of a query's own key in it.  A matrix product names candidates, which are scored exactly."""
    near = q @ x.T
    most = min(limit + 1, len(x))
    least = np.partition(near, len(x) - most, axis=1)[:, len(x) - most]
    asks, found = np.nonzero(near >= least[:, None] - MARGIN)
    other = order[found] != own[asks]
    asks, found = asks[other], found[other]
    score = _dots(x[found], q[asks])
    at = np.lexsort((order[found], -score, asks))
    asks, found, score = asks[at], found[at], score[at]
    within = np.arange(len(asks)) - np.searchsorted(asks, asks)
    return asks[within < limit], found[within < limit], score[within < limit]


def _nearest_in_block(size: int, limit: int, key: str):
    """Over rows sorted by block, its vectors before its queries."""

    def run(batches):
        block, parts, x = None, [], None
        for batch in batches:
            blocks, sides = (np.asarray(batch.column(k)) for k in (0, 1))
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(sides) != 0)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if blocks[a] != block:
                    block, parts, x = blocks[a], [], None
                if sides[a] == 0:
                    parts.append((piece.column(2), piece.column(4), _units(piece.column(5), size)))
                    continue
                if not parts:
                    continue
                if x is None:
                    ids, cells = (pa.concat_arrays([p[k] for p in parts]) for k in (0, 1))
                    x = np.concatenate([p[2] for p in parts])
                    names, order = np.unique(np.array(ids.to_pylist()), return_inverse=True)
                    places = {n: i for i, n in enumerate(names.tolist())}
                q, asking = _units(piece.column(5), size), piece.column(3)
                own = np.array([places.get(n, -1) for n in asking.to_pylist()])
                for k in range(0, len(q), SLICE):
                    asks, found, score = _best(x, order, q[k : k + SLICE], own[k : k + SLICE], limit)
                    yield pa.RecordBatch.from_arrays([asking.take(pa.array(asks + k)), ids.take(pa.array(found)), cells.take(pa.array(found)), pa.array(score)], names=["query_id", key, "cell", "score"])

    return run
