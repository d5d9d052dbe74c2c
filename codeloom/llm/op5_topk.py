"""Operator 5: exact top-k by inner product with ball trees.

Rows are dealt to shards by a hash of their place; a shard becomes one ball tree (split at the median
along the direction of two far points; each node keeps its centre and radius).  The queries of a
shard form a block, which goes to the trees of other shards, never the trees to the queries.  It is
searched in rounds: in its own shard, in about the square root of the others, in the rest.  After each
round the best found anywhere give the current k-th score, which goes with the block as the bound to
beat.  In a tree the nodes wait in a heap in the order of their upper bound ``q.c + |q| r``; those
below the k-th score are left out, and an equal bound is still visited, since ties go to the smaller
id.

Scores are exact: in double where no sum can pass 2^53, else in integers of any size for all rows that
rounding could let in; a score beyond 64 bits is ranked exactly and returned as the nearest long.
Vectors that are null, empty or hold null or non-finite components (also after the multiplication) take
no part, nor do null ids; a vector meets only those of its own length.  Each row is a candidate for
every other row, so rows that repeat an id are found beside each other, and each is a query of its own.
An empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import common

LEAF, SHARD = 64, 16_384
LONG, LARGEST = 1 << 63, int(np.finfo(np.float64).max)


def build_tree(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> dict:
    """Nodes in arrays; a leaf's rows are ``lo..hi`` of the reordered vectors."""
    order, nodes, todo = np.arange(ids.size), [], [(0, ids.size, -1)]
    with np.errstate(over="ignore", invalid="ignore"):
        while todo:
            lo, hi, parent = todo.pop()
            own = x[order[lo:hi]]
            centre = own.mean(0)
            off = ((own - centre) ** 2).sum(1)
            radius = np.sqrt(off.max()) * (1 + 1e-9) + 1e-9
            me = len(nodes)
            nodes.append([lo, hi, -1, -1, centre, radius])
            if parent >= 0:
                nodes[parent][2 if nodes[parent][2] < 0 else 3] = me
            if hi - lo > leaf and radius > 1e-6:
                a = own[off.argmax()]
                b = own[((own - a) ** 2).sum(1).argmax()]
                by = np.argsort(own @ (b - a), kind="stable")
                order[lo:hi] = order[lo:hi][by]
                mid = (lo + hi) // 2
                todo += [(mid, hi, me), (lo, mid, me)]
    exact = float(np.abs(x).max()) < math.sqrt(2.0**53 / x.shape[1])
    return {"rows": rows[order], "ids": ids[order], "x": x[order], "exact": exact, "span": np.array([n[:2] for n in nodes]), "child": np.array([n[2:4] for n in nodes]), "centre": np.array([n[4] for n in nodes]), "radius": np.array([n[5] for n in nodes])}


def as_float(score: int) -> float:
    return float(max(-LARGEST, min(LARGEST, score)))


def inner(a: np.ndarray, b: np.ndarray) -> int:
    return sum(int(u) * int(v) for u, v in zip(a.tolist(), b.tolist(), strict=True))


def search(tree: dict, query_rows: np.ndarray, q: np.ndarray, kth: list[int | None], k: int) -> list[list[tuple[int, int, int]]]:
    """For each query its best ``k`` of this tree as (-score, id, row), at least its ``kth`` score.

    All queries go down the tree together: a node takes those whose bound it may reach."""
    best: list[list[tuple[int, int, int]]] = [[] for _ in query_rows]
    least = np.array([-np.inf if s is None else as_float(s) for s in kth])
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((q * q).sum(1))
        far = np.sqrt((tree["centre"] ** 2).sum(1)) + tree["radius"]
        slack = 4.0 * q.shape[1] * 2.0**-52

        def may(node: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            up = q[rows] @ tree["centre"][node] + norm[rows] * tree["radius"][node] + slack * norm[rows] * far[node] + 1e-6
            up = np.where(np.isnan(up), np.inf, up)
            go = up >= least[rows] - slack * np.abs(least[rows])
            return rows[go], up[go]

        heap: list[tuple] = []

        def push(node: int, rows: np.ndarray) -> None:
            rows, up = may(node, rows)
            if rows.size:
                heapq.heappush(heap, (-float(up.max()), node, rows))

        push(0, np.arange(query_rows.size))
        while heap:
            _, node, rows = heapq.heappop(heap)
            rows, _ = may(node, rows)  # the k-th scores may have risen since
            left, right = tree["child"][node]
            if left >= 0:
                push(left, rows)
                push(right, rows)
                continue
            lo, hi = tree["span"][node]
            scores = q[rows] @ tree["x"][lo:hi].T
            own = tree["rows"][lo:hi]
            for r, s in zip(rows.tolist(), scores, strict=True):
                floor = least[r] if tree["exact"] else least[r] - slack * norm[r] * far[node] - slack * abs(least[r])
                new = np.flatnonzero(~(s < floor) & (own != query_rows[r]))
                if new.size:
                    values = [int(s[c]) for c in new] if tree["exact"] else [inner(q[r], tree["x"][lo + c]) for c in new]
                    best[r] = sorted(best[r] + [(-v, int(tree["ids"][lo + c]), int(own[c])) for v, c in zip(values, new, strict=True)])[:k]
                    if len(best[r]) == k:
                        least[r] = max(least[r], as_float(-best[r][-1][0]))
    return best


def clean(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, x`` of rows that take part, each component as ``floor(256 c)`` in double."""
    scaled = F.transform(vector, lambda c: c.cast("double") * 256)
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("x"))
    ok = (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # from 2^52 on, every double is an integer already, and floor would clip at 64 bits
    return rows.filter(ok).withColumn("x", F.transform("x", lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)))


def top_k(df: DataFrame, k: int = 5, every: int = 50, shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` the ``k``
    best of all other rows.  ``df``: ``vec_id, x`` (integers as double)."""
    rows = common.keep(df.select("vec_id", "x"))
    shards = max(8, -(-rows.count() // shard))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    built = common.keep(numbered.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).groupBy("shard").applyInArrow(_builder(every), "shard long, dim int, tree binary, asks binary"))
    trees = built.select("shard", "dim", "tree")
    asks = built.filter(F.col("asks").isNotNull()).select(F.col("shard").alias("home"), "dim", "asks")
    # offsets of the shards that a block goes to in each round
    near = 1 + math.isqrt(shards - 1)
    found = None
    for lo, hi in ((0, 1), (1, near), (near, shards)):
        if lo >= hi:
            continue
        blocks = asks.withColumn("best", F.lit(None).cast("binary")) if found is None else asks.join(_merged(found, k), ["home", "dim"], "left")
        sent = blocks.withColumn("shard", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long")))).withColumn("shard", F.pmod(F.col("home") + F.col("shard"), F.lit(shards)))
        met = common.keep(trees.join(sent, ["shard", "dim"]).select("shard", "dim", "home", "tree", "asks", "best").mapInArrow(_meet(k), "home long, dim int, found binary"))
        found = met if found is None else found.unionByName(met)
    return asks.join(_merged(found, k), ["home", "dim"]).select("asks", "best").mapInArrow(_listed, "query_id long, rank int, vec_id long, score long")


def _builder(every: int):
    def build(key, group):
        rows, ids, xs = group.column("row").to_numpy(), group.column("vec_id").to_numpy(), group.column("x").combine_chunks()
        size = np.diff(xs.offsets.to_numpy())
        values, starts = xs.values.to_numpy(), xs.offsets.to_numpy()[:-1]
        out = []
        for dim in sorted(set(size.tolist())):
            mine = np.flatnonzero(size == dim)
            mine = mine[np.lexsort([rows[mine], ids[mine]])]
            tree = build_tree(rows[mine], ids[mine], values[starts[mine][:, None] + np.arange(dim)])
            asks = np.flatnonzero(tree["ids"] % every == 0)
            block = pickle.dumps((tree["ids"][asks], tree["rows"][asks], tree["x"][asks])) if asks.size else None
            out.append((key[0].as_py(), dim, pickle.dumps(tree), block))
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "dim", "tree", "asks"])

    return build


def _meet(k: int):
    """Searches a block of queries in a tree; ``found``: the best of each query that has any, by place."""

    def run(batches):
        at, tree = None, None
        for batch in batches:
            out = []
            shard, dim, home = (batch.column(c).to_pylist() for c in range(3))
            for i in range(batch.num_rows):
                if at != (shard[i], dim[i]):
                    at, tree = (shard[i], dim[i]), pickle.loads(batch.column(3)[i].as_py())
                _, rows, q = pickle.loads(batch.column(4)[i].as_py())
                so_far = pickle.loads(batch.column(5)[i].as_py()) if batch.column(5)[i].is_valid else {}
                kth = [-so_far[n][-1][0] if len(so_far.get(n, ())) == k else None for n in range(rows.size)]
                found = {n: best for n, best in enumerate(search(tree, rows, q, kth, k)) if best}
                if found:
                    out.append((home[i], dim[i], pickle.dumps(found)))
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["home", "dim", "found"])

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """``home, dim, best``: the best ``k`` of each query of a block in all trees so far."""

    def run(key, group):
        best: dict[int, list] = {}
        for blob in group.column("found"):
            for n, more in pickle.loads(blob.as_py()).items():
                best[n] = sorted(best.get(n, []) + more)[:k]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), pa.array([pickle.dumps(best)], pa.binary())], names=["home", "dim", "best"])

    return found.groupBy("home", "dim").applyInArrow(run, "home long, dim int, best binary")


def _listed(batches):
    for batch in batches:
        out = []
        for asks, blob in zip(batch.column(0), batch.column(1), strict=True):
            ids, _, _ = pickle.loads(asks.as_py())
            for n, best in pickle.loads(blob.as_py()).items():
                out += [(int(ids[n]), rank, vec, max(-LONG, min(LONG - 1, -s))) for rank, (s, vec, _) in enumerate(best, 1)]
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query_id", "rank", "vec_id", "score"])


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(clean(common.table(spark, sf_dir, "embeddings")))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x, row_number() OVER () AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r AS r, v.vec_id AS vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.r <> v.r AND len(q.x) = len(v.x)),
n AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM n WHERE rank <= 5
"""
