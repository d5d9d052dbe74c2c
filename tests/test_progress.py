"""Subscriptions to the progress of a sync, and figures taken while steps are written."""

import threading
import time

from pyspark.sql import functions as F

from codeloom.plans.engine import Engine
from codeloom.plans.progress import DEPTH, Progress
from codeloom.runtime import keep_counted


def status(state, n=0):
    return {"state": state, "n": n}


def test_snapshot_then_updates_then_the_end():
    p = Progress()
    early = p.subscribe(lambda: status("idle"), lambda: True)
    p.publish(status("running", 1))
    late = p.subscribe(lambda: status("running", 1), lambda: True)
    p.publish(status("running", 2))
    p.publish(status("done", 3))
    p.publish(status("running", 4))  # another run is none of theirs
    assert [s["n"] for s in early] == [0, 1, 2, 3] and [s["n"] for s in late] == [1, 2, 3]
    assert len(p) == 0 and next(early, None) is None


def test_a_slow_subscriber_loses_the_oldest_and_gets_the_end():
    p = Progress()
    s = p.subscribe(lambda: status("running"), lambda: True)
    for n in range(1000):
        p.publish(status("running", n))
    p.publish(status("error", 1000))
    got = [x["n"] for x in s]
    assert got == [0, *range(1001 - DEPTH, 1001)]


def test_ends_when_idle_and_when_closed():
    p = Progress()
    started = time.monotonic()
    assert list(p.subscribe(lambda: status("idle"), lambda: False, idle=0.2)) == [status("idle")]
    assert 0.2 <= time.monotonic() - started < 2 and len(p) == 0
    with p.subscribe(lambda: status("running"), lambda: True, idle=0.1) as s:
        next(s)
        threading.Timer(0.1, s.close).start()
        assert list(s) == []
    busy = threading.Event()
    busy.set()
    s = p.subscribe(lambda: status("running"), busy.is_set, idle=0.1)
    threading.Timer(0.4, lambda: p.publish(status("done", 9))).start()
    assert [x["n"] for x in s] == [0, 9]  # longer than ``idle``, but a run is under way


def test_subscribers_of_a_sync(spark, tmp_path, tree):
    engine = Engine(spark, str(tmp_path / "index"))
    early, late, seen = engine.subscribe(), [], []

    def follow():
        seen.extend(early)

    def join_late(s):
        if s["phase"] == "embed":
            late.append(engine.subscribe())

    engine.listeners.append(join_late)
    t = threading.Thread(target=follow)
    engine._running = True  # the thread may be ahead of the sync
    t.start()
    engine.sync(str(tree))
    t.join(20)
    assert not t.is_alive()
    assert [s.get("phase") for s in seen] == [None, "scan", "parse", "embed", "graph", "finalize", "done"]
    assert seen[-1]["state"] == "done" and seen[-1]["files_total"] == seen[-1]["files_changed"] == 12 and seen[-1]["chunks_done"] == engine.table("chunks").count()
    assert "files_total" not in seen[1] and [s["percent"] for s in seen[1:]] == sorted(s["percent"] for s in seen[1:])
    assert [s["phase"] for s in late[0]] == ["embed", "graph", "finalize", "done"]
    assert [s["state"] for s in engine.subscribe(idle=0.1)] == ["done"]
    # only deletions: no chunk is made
    (tree / "web/store.js").unlink()
    assert engine.sync(str(tree))["deleted"] == 1 and engine.status()["chunks_done"] == 0 == engine.status()["files_changed"]
    # a tree that has become empty
    empty = tmp_path / "empty"
    empty.mkdir()
    got = engine.sync(str(empty), repo="ember")
    assert (got["deleted"], got["files"], got["chunks"], got["loc"]) == (11, 0, 0, 0)


def test_figures_of_kept_steps(spark):
    figures = {"n": F.count(F.lit(1)), "total": F.coalesce(F.sum("id"), F.lit(0)), "odd": F.count_if(F.col("id") % 2 == 1)}
    kept, got = keep_counted(spark.range(10_000).repartition(7), **figures)
    assert got == {"n": 10_000, "total": 49_995_000, "odd": 5_000} and kept.count() == 10_000
    nothing = [spark.range(0), spark.range(5).filter("id > 9"), spark.range(5).filter("false"), spark.createDataFrame([], "id long"), spark.range(5).join(spark.range(9).filter("id > 20"), "id")]
    for df in nothing:
        kept, got = keep_counted(df, **figures)
        assert got == {"n": 0, "total": 0, "odd": 0} and kept.count() == 0
