"""Results shaped for tools, and the limiter's state over micro-batches."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom.operators import limiter
from codeloom.plans import tools
from codeloom.plans.engine import Engine


def said(df):
    rows = df.collect()
    assert len(rows) == 1 and dict(df.dtypes) == {"result": "variant"}
    return json.loads(df.select(F.to_json("result").alias("j")).first().j)


def test_shapes(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    assert said(tools.search_code(engine, "anything"))["results"] == []
    assert "error" in said(tools.repo_map(engine))
    (tree / "ember/long.py").write_text("\n".join(f"def long_name_{i}():\n    return {i}\n" for i in range(30)))
    engine.sync(str(tree))
    got = said(tools.search_code(engine, "cut_blocks"))
    assert got["repo"] == "ember" and got["results"][0]["path"] == "ember/blocks.py" and got["note"] is None
    assert set(got["results"][0]) == {"path", "lines", "score", "symbols", "content"} and "-" in got["results"][0]["lines"]
    wide = [h for h in said(tools.search_code(engine, "long_name_3", 99))["results"]]
    assert len(wide) <= 20 and all(len(h["symbols"]) <= 8 and len(h["content"]) <= 1500 for h in wide)
    assert [h["score"] for h in wide] == sorted((h["score"] for h in wide), reverse=True)

    part = said(tools.read_file(engine, str(tree), "ember/blocks.py", 4, 5))
    assert part == {"path": "ember/blocks.py", "start_line": 4, "end_line": 5, "total_lines": 17, "content": "@dataclass\nclass Block:"}
    assert said(tools.read_file(engine, str(tree), "ember/blocks.py"))["end_line"] == 17
    for bad in ("../../etc/passwd", "nowhere.py"):
        assert "error" in said(tools.read_file(engine, str(tree), bad))

    whole = said(tools.repo_map(engine))
    assert whole["stats"]["files"] == 13 and {"id", "files", "loc"} == set(whole["modules"][0]) and len(whole["top_files"]) == 12
    assert whole["modules"][0]["id"] == "ember" and whole["dependencies"] == [{"from": "scripts", "to": "ember"}]
    assert {s["name"] for s in said(tools.get_symbols(engine, "ember/parser.py"))["symbols"]} >= {"NoteParser", "parse", "parse_note"}
    assert "error" in said(tools.get_symbols(engine, "nowhere.py"))


def test_symbols_of_anything(spark):
    raw = ['[{"kind": "class", "name": "A", "line": 3}]', '["a", "b"]', "[{", "7", '"x"', "{}", "[]", "", None]
    df = spark.createDataFrame([(r,) for r in raw], "r string").select(tools.symbols_of(F.col("r")).alias("s"))
    assert [[tuple(s) for s in r.s] for r in df.collect()] == [[("class", "A", 3)], [(None, "a", None), (None, "b", None)], [], [], [], [], [], [], []]


def test_state_is_carried_over_micro_batches(spark, tmp_path):
    from codeloom.streaming.limiter import rate_limit_stream

    events = spark.createDataFrame([(f"k{i % 3}", i, float(i * 7 % 50 + 50 * (i // 50))) for i in range(200)] + [("late", 900, 0.0), ("late", 901, 5000.0)], "key string, id long, at double")
    want = sorted(map(tuple, limiter.rate_limit(events, 3, 60.0).collect()))
    # two files, one a micro-batch, the second of later calls; most windows reach over the cut
    for k, part in enumerate((events.filter("at < 100"), events.filter("at >= 100"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"p{k}"))
    source = tmp_path / "in"
    source.mkdir()

    def run(name):
        stream = rate_limit_stream(spark.readStream.schema(events.schema).parquet(str(source)), 3, 60.0)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    for k in range(2):  # the second run starts from the first one's checkpoint
        for f in (tmp_path / f"p{k}").glob("part-*.parquet"):
            f.rename(source / f"{k}-{f.name}")
        run(k)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want
