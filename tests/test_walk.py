"""Walks of source trees: what is entered, what is read, and that tasks do it."""

import os

import pyarrow.fs as arrow_fs
import pytest

from codeloom.sources import files, walk
from codeloom.sources.ignore import IgnoreRules

MADE = {
    ".gitignore": "out/\nlogs/*\n!logs/keep.txt\n*.tmp\n/top.txt\n", "a.py": "x = 1\n", "top.txt": "t", "deep/top.txt": "t", "out/x.py": "x = 1\n", "logs/keep.txt": "kept\n", "logs/drop.txt": "d\n",
    "lib/out/y.py": "y\n", "lib/__pycache__/c.py": "c\n", "lib/.git/config": "c\n", "lib/__init__.py": "", "lib/_hidden/.env.sample": "E=1\n", "lib/a b#[1]{x}.py": "odd = 1\n", "node_modules/m.js": "m\n", "lib/node_modules/n.js": "n\n",
    "pic.png": "p", "big.txt": "b" * 3000, "noise.tmp": "n", "nul.dat": "a\0b",
}
KEPT = {".gitignore", "a.py", "deep/top.txt", "logs/keep.txt", "lib/__init__.py", "lib/_hidden/.env.sample", "lib/a b#[1]{x}.py", "lib/node_modules/n.js"}


@pytest.fixture
def made(tmp_path):
    for path, content in MADE.items():
        at = tmp_path / "tree" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content)
    os.symlink(tmp_path / "tree" / "lib", tmp_path / "tree" / "loop")  # a link to a folder is not followed
    os.symlink(tmp_path / "nowhere", tmp_path / "tree" / "broken.py")
    return tmp_path / "tree"


def test_scan_reads_what_the_rules_leave(spark, made):
    got = {r.path: r for r in files.scan(spark, str(made), max_kb=2).collect()}
    assert set(got) == KEPT
    assert got["lib/a b#[1]{x}.py"].content == "odd = 1\n" and got["lib/__init__.py"].size == 0
    assert {r.path for r in files.scan(spark, f"file://{made}", max_kb=2).collect()} == set(got)


def test_both_ways_of_a_scan_agree(spark, made, monkeypatch):
    """A store that only Spark reaches is listed by Spark."""
    a = sorted(map(tuple, files.scan(spark, str(made), max_kb=2).collect()))
    monkeypatch.setattr(files, "opener", lambda root: None)
    os.unlink(made / "loop")  # Hadoop follows links
    os.unlink(made / "broken.py")
    assert sorted(map(tuple, files.scan(spark, str(made), max_kb=2).collect())) == a
    assert walk.opener("viewfs://cluster/tree") is None


def test_an_ignored_folder_is_never_listed(made):
    class Watched(walk.Disk):
        def entries(self, folder):
            opened.append(folder)
            return super().entries(folder)

    opened = []
    rules = IgnoreRules([MADE[".gitignore"].splitlines()], ["node_modules"])
    got = {p for p, _, folder in walk.below(Watched(str(made)), rules.matcher(), "") if not folder}
    assert set(opened) == {"", "deep", "logs", "lib", "lib/_hidden", "lib/node_modules"} and len(opened) == 6
    assert got == KEPT | {"pic.png", "big.txt", "nul.dat"}


def test_rounds_hand_on_what_is_left(spark, tmp_path):
    """With a span of three entries every round opens few folders; the whole is the same."""
    want = set()
    for i in range(5):
        for j in range(4):
            at = tmp_path / "t" / f"d{i}" / f"e{j}" / "f"
            at.mkdir(parents=True)
            (at / "x.py").write_text("x")
            want.add(f"d{i}/e{j}/f/x.py")
    rules, opened = IgnoreRules(), walk.opener(str(tmp_path / "t"))
    once = walk.listing(spark, opened, rules)
    often = walk.listing(spark, opened, rules, span=3)
    assert len(once) == 1 and len(often) == 3  # the root; its folders; theirs, each with the one below
    for rounds in (once, often):
        rows = [r.path for df in rounds for r in df.filter("NOT folder").collect()]
        assert len(rows) == len(want) and set(rows) == want


def test_a_store_that_arrow_opens(made):
    there = walk.Remote(f"file://{made}")
    assert isinstance(there.fs, arrow_fs.LocalFileSystem)
    assert {("a.py", False, 6), ("lib", True, 0)} <= set(there.entries("")) and list(there.entries("none")) == []
    assert there.read("a.py") == b"x = 1\n" and there.read("none") is None


def test_empty_and_missing_trees(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert files.scan(spark, str(tmp_path / "empty")).collect() == []
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path / "missing"))
