"""Functions that SQL calls, and the limiter on a key with very many calls."""

from pyspark.sql import functions as F

from codeloom.functions import tables, text
from codeloom.operators import chunking, limiter


def test_lateral_calls_equal_the_operator(spark):
    tables.register(spark)
    rows = [("a.c", "c", "int add(int a) {\n  return a;\n}\n"), ("b.rb", "ruby", "class B\n  def c\n  end\nend\n"), ("n", None, "x"), ("e", "go", ""), ("m", "python", None), ("y.yaml", "yaml", "a: 1\n")]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    want = chunking.chunk_files(files).select("path", "ordinal", "start_line", "end_line", "symbols", "content").collect()
    got = spark.sql("SELECT f.path, c.ordinal, c.start_line, c.end_line, c.symbols, c.content FROM {f} AS f, LATERAL chunk_file(f.language, f.content) AS c", f=files).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 3
    symbols = spark.sql("SELECT s.* FROM {f} AS f, LATERAL file_symbols(f.language, f.content) AS s ORDER BY name", f=files).collect()
    assert [tuple(r) for r in symbols] == [("class", "B", 1), ("function", "add", 1), ("method", "c", 2)]


def test_query_cleaning_in_sql(spark):
    tables.register(spark)
    asked = ["find the parser", "a", "", 'say "hi" AND (x.y)', "naïve Straße", " ".join(f"w{i}" for i in range(30)), None]
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    both = df.select(F.expr("fts_query(q)").alias("sql"), text.fts_query(F.col("q")).alias("column")).collect()
    assert all(r.sql == r.column for r in both)


def test_limiter_carries_a_key_over_its_batches(spark):
    calls = spark.range(60_000).select(F.lit("hot").alias("key"), "id", F.col("id").cast("double").alias("at"))
    some = spark.createDataFrame([(None, 1, 0.0), (None, 2, 1.0), ("cold", 3, 5.0), ("", 4, 5.0)], "key string, id long, at double")
    got = limiter.rate_limit(calls.unionByName(some), 5, 1000.0)
    # five of every thousand: the window holds five until the first of them is a thousand seconds old
    allowed = [r.id for r in got.filter("key = 'hot' and allowed").orderBy("id").collect()]
    assert allowed == [k for k in range(60_000) if k % 1000 < 5]
    assert got.filter("key is null or key <> 'hot'").filter("allowed").count() == 4
    assert got.filter("key is null").orderBy("id").collect()[1].remaining == 3
    assert limiter.rate_limit(calls.limit(0), 5, 100.0).count() == 0
