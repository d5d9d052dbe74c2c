"""Vectors trained on the index itself."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from codeloom.operators import meaning
from codeloom.operators.embedding import build_embedder
from codeloom.plans.engine import Engine


def plain_ppmi(texts, window):
    n = Counter()
    for t in texts:
        words = re.findall(r"\w+", t or "")
        for i, a in enumerate(words):
            for b in words[i + 1 : i + 1 + window]:
                n[a, b] += 1
                n[b, a] += 1
    one = Counter()
    for (a, _), c in n.items():
        one[a] += c
    every = sum(n.values())
    return {k: s for k, c in n.items() if (s := math.log(c * every / (one[k[0]] * one[k[1]]))) > 1e-12}


TEXTS = ["the car has an engine and wheels", "the automobile has wheels and an engine", "a car needs fuel", "the automobile needs fuel", "sugar sweetens the cake", "bake a cake with sugar", "", None, "one", "car car car"]


def test_ppmi_and_its_eigenvectors(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(F.regexp_extract_all("t", F.lit(r"(\w+)")).alias("tokens"))
    got = {(r.a, r.b): r.ppmi for r in meaning.ppmi(df).filter("ppmi > 1e-12").collect()}
    want = plain_ppmi(TEXTS, meaning.WINDOW)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())

    entries = meaning.ppmi(df).select("a", "b", "ppmi")
    terms = sorted({a for a, _ in want})
    dense = np.array([[want.get((a, b), 0.0) for b in terms] for a in terms])
    values, vectors = np.linalg.eigh(dense)
    top = np.argsort(-values)[:3]
    exact = vectors[:, top] * np.sqrt(values[top])
    found = {r.term: r.x for r in meaning.term_vectors(entries, 3, over=len(terms)).collect()}
    x = np.array([found[t] for t in terms])
    assert np.allclose(x @ x.T, exact @ exact.T, atol=1e-6)  # the same up to signs
    assert meaning.term_vectors(entries.limit(0), 3).count() == 0


MADE = {
    "docs/one.md": "The car needs an engine, four wheels and fuel. A driver steers the car on the road with its wheels and brakes.\n",
    "docs/two.md": "An automobile needs an engine, four wheels and fuel. The driver steers an automobile on the road with wheels and brakes.\n",
    "docs/three.md": "Every vehicle with an engine and wheels burns fuel on the road; the driver brakes the car or the automobile.\n",
    "docs/four.md": "Sugar sweetens the cake. Bake flour, butter and sugar in the oven until the cake is brown.\n",
    "docs/five.md": "The oven bakes bread of flour, butter, yeast and salt, and a cake of sugar.\n",
    "docs/six.md": "The old car brakes on the road.\n",
}


def test_a_query_finds_what_shares_no_word_with_it(spark, tmp_path):
    for path, text in MADE.items():
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text(text)
    engine = Engine(spark, str(tmp_path / "index"), build_embedder("corpus", size=16))
    engine.sync(str(tmp_path / "tree"))
    hits = [(r.path, r.sources) for r in engine.search("automobile").collect()]
    places = [p for p, _ in hits]
    # "automobile" stands in two and three only
    assert ("docs/six.md", ["vector"]) in hits and ("docs/one.md", ["vector"]) in hits
    assert places.index("docs/six.md") < min(places.index(p) for p in ("docs/four.md", "docs/five.md"))
    assert places.index("docs/one.md") < min(places.index(p) for p in ("docs/four.md", "docs/five.md"))
    other = Engine(spark, str(tmp_path / "again"), build_embedder("corpus", size=16))
    other.sync(str(tmp_path / "tree"))
    a, b = ({r.chunk_id: r.embedding for r in e.table("vectors").collect()} for e in (engine, other))
    assert a.keys() == b.keys()
    for k in a:
        assert np.dot(a[k], b[k]) == pytest.approx(1.0, abs=1e-5) or not any(a[k])
    # a new file is embedded with the stored terms
    (tmp_path / "tree/docs/seven.md").write_text("An automobile of my own.\n")
    assert engine.sync(str(tmp_path / "tree"))["new"] == 1
    assert engine.table("vectors").filter("path = 'docs/seven.md'").count() == 1
    assert engine.search("automobile").filter("path = 'docs/seven.md'").count() == 1
    assert engine.search("zzz").count() == 0


def lists(spark, texts):
    from pyspark.sql import functions as F

    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_extract_all("t", F.lit(r"(?U)(\w+)")).alias("tokens"))


@pytest.mark.parametrize(("chunk", "block"), [(1 << 20, 6_000_000), (7, 40), (1, 3)])
def test_pairs_by_chunks_and_blocks(spark, monkeypatch, chunk, block):
    from codeloom.operators import pairs

    monkeypatch.setattr(pairs, "CHUNK", chunk)
    texts = [*TEXTS, "a b a a c d a b b e f g a " * 9, "ß ä 漢字 a"]
    want = plain_ppmi(texts, meaning.WINDOW)
    held = pairs.Pairs(lists(spark, texts), meaning.WINDOW, block)
    assert held.ranges > 1 or block > 1000
    got = held.rows().collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b): pytest.approx(r.ppmi) for r in got if r.ppmi > 1e-12} == want
    by = {}
    for r in got:
        company, n, ppmi = by.get(r.a, (0, 0, 0.0))
        by[r.a] = company + 1, n + r.n, ppmi + round(r.ppmi, 6)
    sums = held.sums().collect()
    assert {r.term: (r.company, r.n) for r in sums} == {k: v[:2] for k, v in by.items()}
    assert all(r.ppmi == pytest.approx(by[r.term][2], abs=1e-9) for r in sums)


def test_no_pair_is_sent_as_a_row(spark):
    plan = meaning.company(lists(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" not in plan and "hashpartitioning(b#" not in plan
    assert meaning.company(lists(spark, TEXTS).limit(0)).count() == 0 == meaning.ppmi(lists(spark, ["", None])).count()
