"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import common


class Forest:
    """Union-find over positions; the smaller root stays."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


HOT = 1000  # a key with more than one row in so many is joined by broadcast: fewer than HOT keys


def join_hot(rows: DataFrame, small: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``small`` (one row a key, with the number of its rows as ``weight``), by
    ``inner`` or ``left``.  The few keys that hold more than one in ``HOT`` of all rows are joined by
    broadcast, so that none of them gathers in one task."""
    total = small.agg(F.sum(weight)).first()[0] or 0
    few = small.filter(F.col(weight) * HOT > total).collect()  # fewer than HOT rows
    if not few:
        return rows.join(small, keys, how)
    hot = small.sparkSession.createDataFrame(few, small.schema)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small, keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def _contract(batches):
    """Stars that join what the edges of some batches join."""
    held, many = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        many += batch.num_rows
        if many > 1 << 18:
            held = [_stars(held)]
            many = held[0].shape[1]
            if many > 1 << 17:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["a", "b"])
                held, many = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(held)], ["a", "b"])


def _stars(held: list[np.ndarray]) -> np.ndarray:
    a, b = np.concatenate(held, 1)
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(names.size)
    for i, j in np.unique(np.stack([at[: a.size], at[a.size :]], 1), axis=0).tolist():
        forest.join(i, j)
    root = np.array([forest.root(i) for i in range(names.size)], np.int64)
    own = np.flatnonzero(root != np.arange(names.size))
    return np.stack([names[own], names[root[own]]])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for each end of ``a, b`` (long).

    Alternating stars; a hub's minimum is pre-aggregated and joined by ``join_hot``."""
    edges = common.keep(edges.select("a", "b").filter("a <> b").mapInArrow(_contract, "a long, b long").distinct())
    before = None
    while (now := _mark(edges)) != before:
        before = now
        # large star: each neighbour above u goes to the least of u and its neighbours
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("many")))
        large = join_hot(both, least, ["a"], "many").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = common.keep(large.distinct())
        common.discard(edges, least)
        # small star: u and its neighbours below go to the least of them (here a > b throughout)
        least = common.keep(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("many")))
        joined = join_hot(large, least, ["a"], "many")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = common.keep(small.distinct())
        common.discard(large, least)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
