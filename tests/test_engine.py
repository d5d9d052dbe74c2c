"""A source tree from scan to search, map, context and incremental sync."""

import pytest

from codeloom.plans.engine import Engine, NoIndex


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "index"))


def test_life_of_an_index(spark, engine, tree):
    assert engine.search("anything").count() == 0
    with pytest.raises(NoIndex):
        engine.table("files")
    seen = []
    engine.listeners.append(lambda s: seen.append(s["phase"]))
    done = engine.sync(str(tree))
    assert done["files"] == 12 and done["new"] == 12 and done["chunks"] >= 8 and done["chunks_done"] == done["chunks"]
    assert seen == ["scan", "parse", "embed", "graph", "finalize", "done"] and engine.status()["state"] == "done"
    paths = {r.path for r in engine.table("files").collect()}
    assert "out/generated.js" not in paths and "private.env" not in paths
    assert engine.table("vectors").count() == engine.table("chunks").count() == engine.table("postings").select("chunk_id").distinct().count()
    assert {r.name for r in engine.symbols("ember/blocks.py").collect()} >= {"Block", "cut_blocks"}

    top = engine.search("cut_blocks").collect()
    assert top[0].path == "ember/blocks.py" and set(top[0].sources) <= {"fts", "vector"}
    assert "ember/server.py" in {r.path for r in engine.search("HTTPServer").collect()}
    assert "ember/blocks.py" in {r.path for r in engine.search("ember.blocks AND NOT").collect()}
    # by stems: "parsing" stands nowhere in the tree, "parse" does
    found = [r for r in engine.search("parsing", 50).collect() if "fts" in r.sources]
    assert "ember/parser.py" in {r.path for r in found}

    edges = {(r.source, r.target) for r in engine.table("edges").collect()}
    assert edges == {
        ("ember/parser.py", "ember/blocks.py"), ("ember/store.py", "ember/blocks.py"), ("ember/server.py", "ember/parser.py"), ("ember/server.py", "ember/store.py"),
        ("scripts/build.py", "ember/parser.py"), ("web/main.js", "web/render.js"), ("web/main.js", "web/store.js"),
    }
    m = engine.repo_map()
    files = {r.path: r.score for r in m["top_files"].collect()}
    assert files["ember/blocks.py"] == pytest.approx(0.23425, abs=1e-5) and files["ember/parser.py"] == pytest.approx(0.12857, abs=1e-5)
    assert files["web/render.js"] == pytest.approx(0.08053, abs=1e-5) and files["README.md"] == pytest.approx(0.05651, abs=1e-5)
    nodes = {r.id: r.score for r in m["nodes"].collect()}
    assert nodes == pytest.approx({"ember": 0.55637, "web": 0.21757, ".": 0.11303, "scripts": 0.11303}, abs=2e-5)
    assert [(r.source, r.target, r.weight) for r in m["links"].collect()] == [("scripts", "ember", 1)]
    assert m["stats"].first().files == 12

    # nothing has changed
    again = engine.sync(str(tree))
    assert again["unchanged"] == 12 and again["chunks_done"] == 0 and again["chunks"] == done["chunks"]
    # one file goes, one is rewritten
    (tree / "web/store.js").unlink()
    (tree / "ember/parser.py").write_text("def reworked_entry(text):\n    return text\n")
    third = engine.sync(str(tree))
    assert (third["deleted"], third["modified"], third["new"]) == (1, 1, 0)
    assert "web/store.js" not in {r.path for r in engine.table("chunks").collect()}
    assert engine.search("reworked_entry").first().path == "ember/parser.py"
    fresh = Engine(spark, engine.store.root + "-fresh")
    fresh.sync(str(tree))
    for name in ("chunks", "postings", "edges"):
        columns = [c for c in fresh.table(name).columns]
        assert sorted(map(str, engine.table(name).select(columns).collect())) == sorted(map(str, fresh.table(name).collect()))
    assert engine.store.vacuum() == 2
    calls = {r.stage: r.calls for r in engine.costs().collect()}
    assert calls == {"indexing": 3, "docs": 0}

    events = list(engine.chat("how are notes cut", [("user", "a")] * 8, lambda messages: iter([f"{len(messages)} see [ember/blocks.py:L10] ", "and [made/up.py:L3]"])))
    assert [e["type"] for e in events] == ["context", "token", "token", "done"]
    assert events[-1]["answer"] == "8 see [ember/blocks.py:L10] and [made/up.py]" and events[-1]["citations"] == [{"path": "ember/blocks.py", "line": 10}]

    def broken(_):
        yield "x"
        raise RuntimeError("no model")

    assert [e["type"] for e in engine.chat("q", [], broken)][-1] == "error"
    window = engine.file_window(str(tree), "ember/blocks.py", 4, 5)
    assert window["content"] == "@dataclass\nclass Block:" and window["total"] == 17
    for bad in ("../x", "/etc/passwd", "a/../../x", ""):
        with pytest.raises(ValueError):
            engine.file_window(str(tree), bad)
    assert "ember/server.py" in engine.onboarding()["files"]
    assert engine.onboarding(lambda m: iter(["guide"]))["content"] == "guide" == engine.cached_guide()["content"]


def test_failed_sync_keeps_the_old_version(spark, engine, tree):
    engine.sync(str(tree))
    before = engine.store.current()
    with pytest.raises(Exception):
        engine.sync(str(tree / "nowhere"))
    assert engine.store.current() == before and engine.status()["state"] == "error"


def test_a_sync_writes_what_changed(spark, engine, tree):
    """Copies on write: no data without changes, one bucket of each table for one path."""
    engine.sync(str(tree))
    first, files, tables = engine.store.current(), engine.store.data_files(), engine.store.tables()
    engine.sync(str(tree))
    assert engine.store.data_files() == files and engine.store.current() != first
    assert engine.store.tables() == tables  # another manifest for the same files

    before = {r.chunk_id for r in engine.table("chunks").filter("path = 'ember/store.py'").collect()}
    (tree / "ember/store.py").write_text("import json\n\nfrom ember.blocks import Block\n\n\ndef quite_other_store(path):\n    return [Block(**b) for b in json.load(open(path))]\n")
    engine.sync(str(tree))
    now = engine.store.tables()
    for name in ("files", "chunks", "postings", "imports", "edges", "vectors", "centroids"):
        changed = {b for b in {**now[name]["parts"], **tables[name]["parts"]} if now[name]["parts"].get(b) != tables[name]["parts"].get(b)}
        assert len(changed) == {"edges": 0, "centroids": 0}.get(name, 1), name  # what it imports is the same
    assert engine.store.data_files() == files + 5
    # the old version reads as it was
    assert before == {r.chunk_id for r in engine.store.read("chunks", first).filter("path = 'ember/store.py'").collect()}
    assert len(before & {r.chunk_id for r in engine.table("chunks").collect()}) == 1  # its imports stay a part as they were
    assert engine.table("chunks").count() == engine.table("vectors").count()
    assert engine.store.vacuum(keep=2) == 1 and engine.store.data_files() == files + 5
    assert engine.store.vacuum() == 1 and engine.store.data_files() == files  # five folders that nothing names
    assert engine.search("quite_other_store").first().path == "ember/store.py"


def test_a_crash_before_publishing_leaves_the_old_version(spark, engine, tree, monkeypatch):
    engine.sync(str(tree))
    before, files = engine.store.current(), engine.store.data_files()
    (tree / "ember/store.py").write_text("x = 1\n")
    monkeypatch.setattr(engine.store, "publish", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        engine.sync(str(tree))
    monkeypatch.undo()
    assert engine.store.current() == before and engine.store.data_files() > files
    engine.store.vacuum()
    assert engine.store.data_files() == files
    assert engine.sync(str(tree))["modified"] == 1


def test_modules_of_go_and_guides(spark, engine, tmp_path):
    root = tmp_path / "two"
    made = {
        "one/go.mod": "// a remark\nmodule example.org/one\n\ngo 1.22\n", "one/main.go": 'package main\n\nimport (\n\t"example.org/one/lib"\n\t"example.org/one/tools/deep"\n\t"fmt"\n)\n', "one/lib/a.go": "package lib\n",
        "one/tools/go.mod": 'module "example.org/one/tools"\n', "one/tools/deep/b.go": 'package deep\n\nimport "example.org/one"\n', "lib/a.go": "package lib\n", "tools/deep/b.go": "package deep\n",
    }
    for path, text in made.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    engine.sync(str(root))
    edges = {(r.source, r.target) for r in engine.table("edges").collect()}
    assert edges == {("one/main.go", "one/lib/a.go"), ("one/main.go", "one/tools/deep/b.go"), ("one/tools/deep/b.go", "one/lib/a.go")}

    doc = engine.onboarding(lambda m: iter(["a guide"]), provider="anthropic", model="large")
    assert doc["cost_usd"] == round(doc["tokens"] / 1e6 * 9.0, 6) > 0 and "one/main.go" in doc["files"]
    assert {r.stage: r.cost_usd for r in engine.costs().collect()}["docs"] == pytest.approx(doc["cost_usd"])
    engine.sync(str(root))
    assert engine.cached_guide()["content"] == "a guide"
    (root / "one/main.go").write_text("package main\n")
    engine.sync(str(root))
    assert engine.cached_guide() == {}
    assert engine.table("edges").count() == 1  # what was left by the other module's file
