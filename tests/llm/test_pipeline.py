"""The pipeline against its stages by brute force, on the smallest tables."""

import corpus_pipeline
from codeloom.llm import op6_toxicity

from test_texts import brute_classes
from test_tokens import check_packed

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    (_, toxic), (_, near), (_, private), (_, pack) = corpus_pipeline.STAGES
    kept = toxic(spark, docs, DATA)
    machine = op6_toxicity.learned(spark, DATA)
    rows = docs.collect()
    good = {r.doc_id for r, s in zip(rows, machine.scores([r.text for r in rows]), strict=True) if s < 0.5}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good
    single = near(spark, kept, DATA)
    want = {i for i, n, c in brute_classes([(r.doc_id, r.text) for r in kept.collect()]) if i == c or (i <= 0 and c <= 0)}
    assert single.columns == docs.columns and {r.doc_id or -1 for r in single.collect()} == want
    clean = private(spark, single, DATA)
    assert clean.columns == docs.columns and {r.doc_id or -1 for r in clean.collect()} == want
    packed = pack(spark, clean, DATA).collect()
    bins, tokens = check_packed(packed, clean)
    assert bins <= -(-tokens // 1024) + 2
    assert {(p.doc_id, p.start, p.length, p.ids_crc32) for p in corpus_pipeline.run(spark, DATA).collect()} == {(p.doc_id, p.start, p.length, p.ids_crc32) for p in packed}


def test_rows_that_share_an_id(spark):
    """Unlike texts under one id are no duplicates; copies of any id are, and rows that repeat."""
    near = corpus_pipeline.drop_near_duplicates
    words = [f"w{k}" for k in range(60)]
    one, other, third = " ".join(words), " ".join(reversed(words)), " ".join(words[::2] + words[1::2])
    data = [(1, one, "b"), (1, one, "a"), (1, other, "a"), (2, one + " more", "a"), (2, third, "a"), (3, third, "a"), (0, other, "z"), (4, None, "a"), (4, None, "a"), (None, one, "a"), (None, one, "a"), (5, "", "a")]
    docs = spark.createDataFrame(data, "doc_id long, text string, class_key string")
    got = sorted(map(tuple, near(spark, docs, DATA).collect()), key=str)
    assert got == sorted([(1, one, "a"), (0, other, "z"), (2, third, "a"), (4, None, "a"), (4, None, "a"), (None, one, "a"), (None, one, "a"), (5, "", "a")], key=str)


def test_awkward_rows(spark, rows):
    """Each stage on nulls, empty and very long texts, repeated rows, clashing columns, no rows."""
    docs = rows.withColumn("n_chars", rows.doc_id)
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert stage(spark, docs.limit(0), DATA).count() == 0
        kept.append(out.count())
        docs = out
    machine = op6_toxicity.learned(spark, DATA)
    clean = [r for r in rows.collect() if machine.scores([r.text or ""])[0] < 0.5]
    assert kept[0] == len(clean)
    # 1, 2, 3 and both rows of 14 are one class, 7 and 8, 9 and 10 are one each
    assert kept[1] == kept[2] == len({{2: 1, 3: 1, 14: 1, 8: 7, 10: 9}.get(r.doc_id, r.doc_id) for r in clean})
    assert {r.doc_id for r in docs.collect()} == {{2: 1, 3: 1, 14: 1, 8: 7, 10: 9}.get(r.doc_id, r.doc_id) for r in clean}
