"""The inverted file against the exact search."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import retrieval, vector_index


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(-1, None), (-2, [0.0] * 64), (-3, [1.0, 2.0]), (-4, [float("nan")] * 64), (-5, [])], "vec_id long, embedding array<float>")
    at = str(tmp_path_factory.mktemp("ivf") / "index")
    rows = vectors.unionByName(odd)
    return rows, vector_index.build(rows, "vec_id", "embedding", 64, at, cells=40), spark.read.parquet(at)


def test_every_vector_lies_in_the_cell_of_its_nearest_centroid(index):
    rows, centroids, table = index
    assert table.count() == rows.count() and 30 < len(centroids) <= 40
    for r in table.filter("vec_id % 97 = 0 or vec_id < 0").collect():
        assert r.cell == -1 if r.vec_id < 0 else r.cell == vector_index.nearest_cells(centroids, r.embedding, 1)[0]
    assert {c.cell for c in table.select("cell").distinct().collect()} - {-1} <= set(range(len(centroids)))


def test_recall_of_other_queries_than_the_calibrated_ones(index):
    _, centroids, table = index
    table = table.filter("cell >= 0")
    probes = vector_index.calibrate(table, centroids, "vec_id", "embedding")
    queries = table.filter("vec_id % 50 = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    pairs = lambda p: {(r.query_id, r.vec_id) for r in vector_index.search_many(table, centroids, queries, "vec_id", "embedding", probes=p).collect()}
    exact, found = pairs(None), pairs(probes)
    assert len(exact) == 24 * queries.count()
    assert len(exact & found) / len(exact) >= 0.9 and probes < len(centroids)
    one = len(exact & pairs(1)) / len(exact)
    assert one < 0.9  # the calibration is needed


def test_probes_open_folders_and_all_of_them_are_exact(index):
    rows, centroids, table = index
    query = table.filter("vec_id = 5").first().embedding
    where = F.col("vec_id") >= 0
    want = retrieval.nearest(rows, "vec_id", "embedding", query, where=where & (F.col("vec_id") != 5)).collect()
    assert vector_index.search(table, centroids, "vec_id", "embedding", query, where=where & (F.col("vec_id") != 5)).collect() == want
    few = vector_index.search(table, centroids, "vec_id", "embedding", query, probes=3)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan and few.first().vec_id == 5
    assert vector_index.nearest_cells(centroids, [1.0], 3) == [] == vector_index.nearest_cells([], query, 3)


def test_same_cells_at_every_run_and_small_tables(spark, index):
    rows, _, _ = index
    some = rows.filter("vec_id between 0 and 600")
    runs = [vector_index.train(some.repartition(3, "vec_id"), "vec_id", "embedding", 64, 4) for _ in range(2)]
    assert runs[0] == runs[1]
    assert vector_index.train(rows.filter("vec_id < 0"), "vec_id", "embedding", 64) == []
    assert {r.cell for r in vector_index.assign(rows.filter("vec_id < 0"), "embedding", []).collect()} == {-1}
    one = vector_index.train(some, "vec_id", "embedding", 64)
    assert len(one) == 1 and [vector_index.cells_for(n) for n in (0, 1, 2047, 1 << 20, 1 << 40)] == [1, 1, 1, 1024, 4096]
    # a third of all rows are one vector: they lie in one cell, written by several tasks
    hot = rows.filter("vec_id >= 0").unionByName(spark.range(1000).select((F.col("id") + 10_000).alias("vec_id"), F.lit(rows.filter("vec_id = 3").first().embedding).alias("embedding")))
    centroids = vector_index.train(hot, "vec_id", "embedding", 64, 8)
    assert vector_index.assign(hot, "embedding", centroids).filter("vec_id >= 10000 or vec_id = 3").select("cell").distinct().count() == 1


def test_many_queries_meet_blocks_and_make_no_pairs(spark, tmp_path, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vector_index, "BLOCK", 40)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 8)).astype("float32")
    x[100:160] = x[7]  # copies: ties go to the smaller key
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(300, [0.0] * 8), (301, [float("nan")] * 8), (302, [1.0])]
    vectors = spark.createDataFrame(rows, "k long, e array<float>")
    centroids = vector_index.build(vectors, "k", "e", 8, str(tmp_path / "ivf"), cells=3)
    queries = vectors.filter("k % 10 = 7").selectExpr("k as query_id", "e as query")
    found = vector_index.search_many(spark.read.parquet(str(tmp_path / "ivf")), centroids, queries, "k", "e", 5)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    got = {(r.query_id, r["rank"]): r.k for r in found.collect()}
    u = x.astype("float64")
    u /= np.sqrt((u * u).sum(1))[:, None]
    for q in range(7, 300, 10):
        s = np.round(u @ u[q], 12)
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [got[q, k] for k in range(1, 6)] == want
    some = vector_index.search_many(spark.read.parquet(str(tmp_path / "ivf")), centroids, queries, "k", "e", 5, probes=1)
    assert all(r.cell == vector_index.nearest_cells(centroids, rows[r.query_id][1], 1)[0] for r in some.collect())
