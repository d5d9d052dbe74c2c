"""Sort-means, fill-in-middle forms and jump sharding against plain versions of them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import op11_kmeans, op12_fim, op13_sharding

# ---- sort-means


def plain_clusters(rows, k, rounds, dim, scale):
    """vec_id, cluster, distance, cluster inertia, inertia, digest by Lloyd's rounds over all centroids."""
    ok = [(i, list(v)) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    ints = [(i, [math.floor(Fraction(c) * scale) for c in v]) for i, v in ok]
    order = sorted(range(len(ok)), key=lambda n: (hashlib.sha256(f"3:{'' if ok[n][0] is None else ok[n][0]}".encode()).hexdigest(), ok[n][1]))
    now = [ints[n][1] for n in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(now))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in ints:
            groups[nearest(v)[1]].append(v)
        now = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(now)]
    last = [nearest(v) for _, v in ints]
    inertia = Counter()
    for d, n in last:
        inertia[n] += d
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, now[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(ints, last, strict=True)), key=repr)


def clustered(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    return sorted((tuple(r) for r in op11_kmeans.cluster(df, **options).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_as_by_brute_force(spark, seed):
    random.seed(seed)
    rows = [(n, [random.choice([0.0, 0.25, 0.5, -1.5, random.gauss(n % 3, 0.3)]) for _ in range(3)]) for n in range(300)]
    rows += [(7, rows[7][1])] * 40 + [(7, rows[9][1]), (None, [0.0, 0.0, 0.1]), (301, None), (302, []), (303, [1.0, 2.0]), (304, [1.0, None, 2.0]), (305, [1.0, float("nan"), 2.0]), (306, [float("inf"), 0.0, 0.0])]
    for k, rounds in ((5, 4), (1, 1), (3, 0)):
        assert clustered(spark, rows, k=k, rounds=rounds, dim=3) == plain_clusters(rows, k, rounds, 3, 1024)


def test_clusters_of_ties_copies_and_few_vectors(spark):
    square = [(n, [float(n % 2), float(n // 2)]) for n in range(4)] * 3  # each middle is as far from several
    for rows in (square, [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 9):
        assert clustered(spark, rows, k=4, rounds=3, dim=2) == plain_clusters(rows, 4, 3, 2, 1024)
    assert clustered(spark, [], k=4, rounds=3, dim=2) == []
    assert clustered(spark, [(1, None)], k=4, rounds=3, dim=2) == []


def test_clusters_of_large_components_are_exact(spark):
    rows = [(n, [float(n) * 1e8 + 0.1, -1.0 * n]) for n in range(30)] + [(n, [0.5 * n, 0.25]) for n in range(30, 40)]
    assert clustered(spark, rows, k=3, rounds=3, dim=2, scale=1) == plain_clusters(rows, 3, 3, 2, 1)
    huge = clustered(spark, [(1, [1.7e308, 0.0]), (2, [-1.7e308, 0.0]), (3, [1.0, 1.0])], k=2, rounds=1, dim=2)
    assert len(huge) == 3 and any(r[2] is None and r[4] is None for r in huge)  # beyond 64 bits


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10**6), st.booleans())
def test_assignment_is_nearest_and_least(k, seed, wide):
    draw = np.random.default_rng(seed)
    scale = 10**9 if wide else 1
    whole = lambda n: (draw.integers(-4, 5, (n, 3)) * scale).tolist()
    now, x = op11_kmeans.Centroids(whole(k), 3), op11_kmeans.matrix(whole(40), 3)
    best, least, measured = now.assign(x, draw.integers(0, k, 40))
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(now.rows)) for v in x.tolist()]
    assert [(int(d), int(n)) for d, n in zip(least, best, strict=True)] == want
    assert measured <= 40 * k


def test_near_clusters_need_few_distances():
    draw = np.random.default_rng(0)
    middles = draw.normal(0, 1000, (50, 8)).astype(int)
    own = draw.integers(0, 50, 2000)
    x = op11_kmeans.matrix((middles[own] + draw.integers(-9, 10, (2000, 8))).tolist(), 8)
    assert op11_kmeans.Centroids(middles.tolist(), 8).assign(x, own)[2] < 1.05 * 2000  # of 100,000


def test_rounds_move_assignments_only(spark):
    df = spark.createDataFrame([(n, [n / 7, n % 5 / 3]) for n in range(2000)], "vec_id long, embedding array<double>")
    blocks = op11_kmeans.packed(op11_kmeans.usable(df, "vec_id", "embedding", 2), 2, 1024)
    name = "blocks_of_a_test"
    blocks.repartition(3, "block").write.mode("overwrite").bucketBy(3, "block").saveAsTable(name)
    try:
        held = spark.table(name).select("block", F.lit(b"").alias("assigned"))
        plan = op11_kmeans._beside(spark.table(name).drop("ids"), held.repartition(5))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(block") == 1  # the assignments'; the blocks stay where they are
        assert "Bucketed: true" in plan and "ids#" not in plan.split("Bucketed: true")[0].split("FileScan")[-1]
    finally:
        spark.sql(f"DROP TABLE {name}")


# ---- fill in the middle

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
PIECES = st.lists(st.sampled_from(["a", "Zz", "é", "日", "😀", " ", "\n", "<", ">", "P", "<P", "S>", "<S>", "?", "\0", "K"]), max_size=40).map("".join)


def plain_form(doc_id, text):
    units, (h1, h2, h3, h4) = UNIT.findall(text), op12_fim.draws(doc_id, "1:")
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(0, 10**6))
def test_forms_as_by_brute_force(text, doc_id):
    assert op12_fim.arrange(doc_id, text) == plain_form(doc_id, text)
    _, form, _, _, output = op12_fim.arrange(doc_id, text)
    assert op12_fim.rebuild(output, form) == text


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(1, 9))
def test_places_of_units_by_stretches(text, stretch):
    scan = op12_fim.Scan(text, stretch)
    assert [scan.place(r) for r in range(scan.n + 1)] == [m.start() for m in UNIT.finditer(text)] + [len(text)]
    assert scan.sentinel == bool(re.search("<[PSM]>", text))


def test_a_long_text_holds_one_number_a_stretch():
    scan = op12_fim.Scan("ab, " * 100_000 + "é" * 50_000)
    assert scan.n == 350_000 and scan.before.size == -(-450_000 // op12_fim.STRETCH) + 1
    assert scan.place(300_010) == 400_010


def test_forms_of_awkward_rows(spark, rows):
    made = op12_fim.fill_in_middle(rows.withColumn("output", F.lit(1)))
    assert Counter(made.columns) == Counter([*rows.columns, *op12_fim.ADDED.names])
    got = op12_fim.restore(made.withColumn("restored", F.lit(2)))
    found = [(r.doc_id, r.text, (r.units, r.form, r.prefix_chars, r.middle_chars, r.output), r.restored) for r in got.collect()]
    assert len(found) == rows.count()
    for doc_id, text, form, restored in found:
        assert form == plain_form(doc_id, text or "") and restored == (text or "")
    assert op12_fim.restore(op12_fim.fill_in_middle(rows.limit(0))).count() == 0
    broken = spark.createDataFrame([("x", None), (None, "psm")], "output string, form string")
    assert [r.restored for r in op12_fim.restore(broken).collect()] == [None, None]
    with pytest.raises(ValueError):
        op12_fim.rebuild("<P>a<S>b", "psm")


# ---- sharding


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def digest(doc_id):
    return int(hashlib.sha256(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:16], 16)


def test_shards_as_by_brute_force(spark):
    ids = [*range(3000), -1, -(1 << 63), (1 << 63) - 1, None]
    df = spark.createDataFrame([(i, "s") for i in ids], "doc_id long, shard string")
    for n, more in ((24, 1), (1, 1), (1, 99), (7, 0)):
        got = op13_sharding.assign_shards(df, shards=n, more=more).collect()
        assert {(r.doc_id, r.shard, r.grown_shard) for r in got} == {(i, jump(digest(i), n), jump(digest(i), n + more)) for i in ids}
        assert all(r.grown_shard == r.shard or r.grown_shard >= n for r in got)
    grown = Counter(r.grown_shard != r.shard for r in op13_sharding.assign_shards(df).collect())
    assert 0.6 < grown[True] / (len(ids) / 25) < 1.5
    plan = op13_sharding.assign_shards(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_slots_are_gapless(spark, rows, monkeypatch):
    monkeypatch.setattr(op13_sharding, "PIECE", 16)
    monkeypatch.setattr(op13_sharding, "BUCKETS", 8)
    hot = rows.select("doc_id", "text").unionByName(spark.range(300).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"))).unionByName(spark.range(200).select(F.lit(6).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")))
    narrow = hot.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), F.lit("x").alias("slot"))
    got = op13_sharding.number_slots(op13_sharding.assign_shards(narrow), op13_sharding.spread_of("doc_id", "crc")).collect()
    assert Counter((r.doc_id, r.crc) for r in got) == Counter((r.doc_id, zlib.crc32((r.text or "").encode())) for r in hot.collect())
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
        assert r.shard == jump(digest(r.doc_id), 24)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert op13_sharding.number_slots(op13_sharding.assign_shards(narrow.limit(0)), op13_sharding.spread_of("doc_id", "crc")).count() == 0
