import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import costs, text
from codeloom.functions.porter import stem
from codeloom.operators import chunking, graph, grounding, limiter, retrieval
from codeloom.sources import registry
from codeloom.sources.ignore import IgnoreRules


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("word", "want"),
    {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "triplicate": "triplic", "electrical": "electr", "adjustment": "adjust", "adoption": "adopt", "rate": "rate", "controll": "control", "blocks": "block"}.items(),
)
def test_porter(word, want):
    assert stem(word) == want


def test_paths_and_languages(spark):
    rows = [("a/b.PY", "python", "py", "a", "b"), ("Dockerfile", "dockerfile", "", ".", "Dockerfile"), ("x/.env", None, "", "x", ".env"), ("q/w.tar.gz", None, "gz", "q", "w.tar"), ("m.tsx", "tsx", "tsx", ".", "m"), ("CMakeLists.txt", "cmake", "txt", ".", "CMakeLists")]
    p = F.col("p")
    df = spark.createDataFrame([(r[0],) for r in rows], "p string").select("p", text.language(p), text.extension(p), text.dirname(p), text.stem(p))
    assert [tuple(r) for r in df.collect()] == rows
    assert one(spark, text.lines_of_code(F.lit(""))) == 1 and one(spark, text.lines_of_code(F.lit("a\nb\n"))) == 3
    for raw, want in ((b"a\0b", True), (b"\xff\xfe", True), (b"", False)):
        assert one(spark, text.looks_binary(F.lit(bytearray(raw)))) is want


def test_ignore_rules(spark):
    rules = IgnoreRules([["build/", "*.log", "!keep.log", "/top.txt", "docs/**/x.md", "a?c"], ["keep.log"]], ["web", "node_modules"])
    want = {"build/a": True, "x/build/y/z": True, "build": False, "a/b.log": True, "keep.log": True, "top.txt": True, "d/top.txt": False, "docs/x.md": True, "docs/p/q/x.md": True, "abc": True, "web/main.js": True, "web/sub/deep.js": True, "lib/node_modules/x": False, "website/x": False}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.i for r in df.select("p", rules.ignored(F.col("p")).alias("i")).collect()} == want
    assert {p: rules.ignores(p) for p in want} == want


def test_import_extraction_and_resolution(spark):
    code = "import os, app.core as c\nfrom . import sub\nfrom ..up import x\n  import deep.er\n"
    assert one(spark, graph.python_imports(F.lit(code))) == [".", "..up", "app.core", "deep.er", "os"]
    js = "import a from './a';\nimport '../b.js'\nconst c = require(\"c\"); import('./d')"
    assert one(spark, graph.script_imports(F.lit(js))) == ["../b.js", "./a", "./d", "c"]
    go = 'import "fmt"\nimport (\n  "mod/x"\n  // "mod/no"\n  y "mod/y"\n)\n'
    assert one(spark, graph.go_imports(F.lit(go))) == ["fmt", "mod/x", "mod/y"]
    files = {
        "pkg/__init__.py": "", "pkg/a.py": "from . import b\nfrom .b import x\nimport repo.pkg.c\n", "pkg/b.py": "", "pkg/c.py": "import pkg.a, pkg.a\n",
        "w/a.js": "import './b'; import '../w/b.js'; import 'helper'", "w/b.js": "", "w/c/index.ts": "", "w/d.ts": "import x from './c'", "lib/helper.rb": "",
        "main.go": 'import "mod/util"', "util/z.go": "", "util/a.go": "",
    }
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    got = {(r.source, r.target) for r in graph.import_edges(df, "repo", "mod").collect()}
    want = {("pkg/a.py", "pkg/__init__.py"), ("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/c.py"), ("pkg/c.py", "pkg/a.py"), ("w/a.js", "w/b.js"), ("w/a.js", "lib/helper.rb"), ("w/d.ts", "w/c/index.ts"), ("main.go", "util/a.go")}
    assert got == want
    assert one(spark, graph.collapse(F.lit("web/a/../x.js"))) == "web/x.js"


def plain_rank(n, edges, rounds):
    """PageRank by lists; until the change is below ``n * 1e-6`` where ``rounds`` is None."""
    out = [[t for s, t in edges if s == i] for i in range(n)]
    x = [1 / n] * n
    for _ in range(rounds or 60):
        loose = sum(x[i] for i in range(n) if not out[i])
        new = [0.15 / n + 0.85 * loose / n] * n
        for i in range(n):
            for t in out[i]:
                new[t] += 0.85 * x[i] / len(out[i])
        change, x = sum(abs(a - b) for a, b in zip(new, x, strict=True)), new
        if rounds is None and change < n * 1e-6:
            break
    return x


def test_page_rank(spark):
    nodes = spark.createDataFrame([(i,) for i in range(30)], "path long")
    pairs = sorted({(s, t) for s, t in [(i, (i * i + 3) % 29) for i in range(28)] + [(i, 5) for i in range(0, 20, 3)] if s != t})
    edges = spark.createDataFrame(pairs, "source long, target long")
    for rounds in (None, 1, 4, 6):
        got = {r.path: r.score for r in graph.page_rank(nodes, edges, rounds).collect()}
        assert got == pytest.approx(dict(enumerate(plain_rank(30, pairs, rounds))), abs=1e-9) and sum(got.values()) == pytest.approx(1)
    assert {r.score for r in graph.page_rank(nodes, edges.limit(0)).collect()} == {1.0}


def test_imports_in_text_do_not_count(spark):
    code = 'x = """\nimport no\n"""\nimport a.b, c as d, e\nfrom x import (y)\nfromage import z\nimport f; y = 1\nfrom q import\n'
    assert one(spark, graph.python_imports(F.lit(code))) == ["a.b", "c", "f", "x"]
    js = "// import 'no'\n/* require('no')\n */ export { x } from \"y\"\nrequire('z' + q)\nimport('w' )"
    assert one(spark, graph.script_imports(F.lit(js))) == ["w", "y"]


def test_stems_and_folds(spark):
    assert retrieval.stemmed_phrases("Parsing Éléments") == [["pars", "element"], ["pars"], ["element"]]
    docs = spark.createDataFrame([(1, "It parses the élément, parsed twice."), (2, "nothing here")], "k long, t string")
    got = {(r.term, r.tf) for r in retrieval.postings(docs, "k", "t", stemmed=True).filter("k = 1").collect()}
    assert {("pars", 2), ("element", 1)} <= got


def test_packing_and_windows(spark):
    body = "\n".join(f"line {i} " + "x" * (i % 90) for i in range(900))
    for t in (body, "", "\n\n", "a" * 9000, "b\n" * 10 + "c" * 8000 + "\nd", " x \n" * 2000):
        got = [(c.start_line, c.end_line, c.content) for c in one(spark, chunking.pack_lines(F.lit(t)))]
        assert got == list(chunking.pack(t.split("\n"), 1))
    assert one(spark, chunking.merge_tiny(F.array(*[F.lit(x).cast("long") for x in (10, 50, 60, 5, 70, 80)]))) == [1, 1, 2, 2, 3, 4]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["def f():", "    return 1", "class A:", "", "# note", "x = [", "]", "import os", "  y", "{", "}"]), max_size=60), st.sampled_from(["python", "javascript", "markdown", "go"]))
def test_no_line_is_lost(lines, language):
    chunks = chunking.chunk_file("\n".join(lines), language)
    kept = "\n".join(c[2] for c in chunks)
    for line in lines:
        assert line.strip() in kept
    assert chunking.chunk_file("x", None) == []


def test_symbols():
    names = lambda code, lang: {s[1] for s in chunking.extract_symbols(code, lang)}
    assert names("def alpha():\n    pass\nclass Beta:\n    def gamma(self):\n        pass\n", "python") == {"alpha", "Beta", "gamma"}
    assert names("export function greet(n: string) {\n}\nexport class Greeter {\n  hello() {\n  }\n}\n", "typescript") == {"greet", "Greeter", "hello"}
    assert names("func (s *S) Run(x int) {\n}\ntype S struct {\n}\n", "go") == {"Run", "S"}
    assert len(chunking.chunk_file("def f():\n" + "    x = 1  # padding padding\n" * 900, "python")) > 1


def test_citations_and_context(spark):
    t = "see [a/b.py:L3], [x.md:L9] and [a/b.py:L3] [no] [a/b.py:L4]"
    assert [(c.path, c.line) for c in one(spark, text.citations(F.lit(t)))] == [("a/b.py", 3), ("x.md", 9), ("a/b.py", 4)]
    assert one(spark, text.demote(F.lit(t), F.array(F.lit("a/b.py")))) == "see [a/b.py:L3], [x.md] and [a/b.py:L3] [no] [a/b.py:L4]"
    rows = spark.createDataFrame([(1, "p", 1, 2, "aaaa"), (2, "q", 1, 2, "  \n "), (3, "r", 3, 4, "bbbbbb"), (4, "s", 5, 6, "cc")], "rank int, path string, start_line int, end_line int, content string")
    got = grounding.context_rows(rows, 7)
    assert [(r.path, r.content) for r in got.orderBy("rank").collect()] == [("p", "aaaa"), ("r", "bbb")]
    assert grounding.render_context(got).first().context == "--- p (lines 1-2) ---\naaaa\n\n--- r (lines 3-4) ---\nbbb"


def test_limiter_batch_and_stream_agree(spark, tmp_path):
    assert [d[0] for d in limiter.decide([0, 1, 2, 3, 61], 3, 60)] == [True, True, True, False, True]
    from codeloom.streaming.limiter import rate_limit_stream

    events = spark.createDataFrame([(f"k{i % 3}", i, float(i * i % 400)) for i in range(200)], "key string, id long, at double")
    batch = sorted(map(tuple, limiter.rate_limit(events, 3, 50.0).collect()))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rate_limit_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 3, 50.0)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("limited").collect())) == batch


def test_query_language(spark):
    assert retrieval.query_phrases("split_blocks") == [["split", "blocks"]]
    assert retrieval.query_phrases("cats AND dogs a") == [["cats", "and", "dogs"], ["cats"], ["and"], ["dogs"]]
    assert one(spark, text.fts_query(F.lit("read_file (x) now"))) == '"read_file now" OR read_file OR now'
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "cat the cat the"), (3, None), (4, "")], "k long, t string").fillna("")
    for phrases in (retrieval.query_phrases("the cat"), [["zebra"]], []):
        a = [tuple(r) for r in retrieval.bm25(docs, "k", "t", phrases).collect()]
        figures = docs.agg(F.count("*"), F.avg(F.size(text.analyze(F.col("t"))))).first()
        b = [tuple(r) for r in retrieval.bm25_indexed(retrieval.postings(docs, "k", "t"), tuple(figures), "k", phrases).collect()]
        assert a == b


def test_registry(spark, tmp_path):
    r = registry.Registry(tmp_path / "c" / "config.json")
    a, b = r.add("a", "/a"), r.add("b", "/b")
    with pytest.raises(ValueError):
        r.add("again", "/a")
    r.change(a["id"], last_sync=100.0)
    r.change(b["id"], last_sync=200.0)
    assert r.latest() == b["id"] and r.frame(spark).count() == 2
    assert r.remove(b["id"]) and not r.remove(b["id"]) and r.latest() == a["id"]
    assert r.update("llm", {"model": "m"})["llm"]["model"] == "m" and r.load()["llm"]["provider"] == "openai"
    with pytest.raises(ValueError):
        r.update("indexing", {"max_file_size_kb": 0})
    repos = registry.read_repo_list("repos:\n  - id: one\n    name: 'One'\n    languages: [go, c]\n    loc: 480\n  - name: no id\n  - id: two\n    languages:\n      - py\n")
    assert [(x["id"], x["languages"], x["loc"]) for x in repos] == [("one", ["go", "c"], 480), ("two", ["py"], 0)]
    assert registry.sanitise_keys({"api_key": " k ", "api_base": "", "other": "x"}) == {"api_key": "k"}


def test_costs(spark):
    assert one(spark, costs.actual(F.lit("openai"), F.lit("gpt-4o-mini"), F.lit(1_000_000))) == 0.4
    assert one(spark, costs.model_route(F.lit("anthropic"), F.lit("x"))) == "anthropic/x" and one(spark, costs.model_route(F.lit("openai"), F.lit("gpt-4o"))) == "gpt-4o"


def test_stemmed_postings_of_a_search_group_its_own_words_only(spark):
    docs = spark.createDataFrame([(1, "Parsing parsed the élément parses"), (2, "other words only"), (3, None), (4, "parse ELEMENTS")], "k int, t string")
    whole = retrieval.postings(docs, "k", "t", stemmed=True).filter("term in ('pars', 'element')").collect()
    own = retrieval.postings(docs, "k", "t", stemmed=True, terms=["element", "pars"])
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, whole)) and len(whole) == 4
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join")  # texts' words meet the spellings below the grouping
    plain = retrieval.postings(docs, "k", "t", terms=["the"]).collect()
    assert [(r.term, r.k, r.tf, r.positions) for r in plain] == [("the", 1, 1, [2])]


def test_budgets_of_groups_join_no_texts_beyond_them(spark):
    rows = [("a" if k % 3 else None, k, "x" * (k % 7) + " " * (k % 2)) for k in range(3_000)] + [("b", 1, " " * 60 + "y"), ("b", 2, "z"), ("b", None, "n"), ("c", 1, None), ("c", 2, "  ")]
    docs = spark.createDataFrame(rows, "g string, k int, content string").repartition(5)
    rows_of = grounding.context_rows(docs, 50, "k", ["g"])
    got = {(r.g, r.k): r.content for r in rows_of.collect()}
    want, used = {}, {}
    for g, k, content in sorted((r for r in rows if (r[2] or "").strip()), key=lambda r: (r[1] is not None, r[1] or 0)):
        if used.get(g, 0) < 50 and content[: 50 - used.get(g, 0)].strip():
            want[g, k] = content[: 50 - used.get(g, 0)]
        used[g] = used.get(g, 0) + len(content)
    assert got == want
    assert "last__" in rows_of._jdf.queryExecution().optimizedPlan().toString()  # texts are joined to the last row within the budget


def test_page_rank_by_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 40)
    monkeypatch.setattr(graph, "PACKED", 25)
    pairs = sorted({(f"n{k % 90}", f"n{(k * 7 + k // 5) % 100}") for k in range(600)})
    paths = [f"n{k}" for k in range(110)]
    edges = spark.createDataFrame([*pairs, *pairs[:50], ("n1", "gone"), (None, "n1")], "source string, target string")
    got = {r.path: r.score for r in graph.page_rank(spark.createDataFrame([(p,) for p in paths], "path string"), edges, rounds=5).collect()}
    out = {p: [b for a, b in pairs if a == p] for p in paths}
    want = dict.fromkeys(paths, 1 / 110)
    for _ in range(5):
        loose = sum(want[p] for p in paths if not out[p])
        new = {p: 0.15 / 110 + 0.85 * loose / 110 for p in paths}
        for p in paths:
            for b in out[p]:
                new[b] += 0.85 * want[p] / len(out[p])
        want = new
    assert got == pytest.approx(want)
    kept = graph.page_rank(spark.createDataFrame([("a",), ("b",)], "path string"), edges.limit(0))
    assert {r.path: r.score for r in kept.collect()} == {"a": 1.0, "b": 1.0}
