"""Source trees walked by tasks: folders are rows, and an ignored folder is never opened.

A task lists below its folder until it has seen ``SPAN`` entries and hands on the folders that are
left, which the next round deals to all tasks.  So a small tree takes one round, and no task's work
grows with the tree.  The driver sees neither paths nor contents."""

from __future__ import annotations

import functools
import os
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.runtime import discard, keep
from codeloom.sources.ignore import IgnoreRules

SPAN = 4_096  # entries that a task lists below a folder before it hands on the rest
ROWS = 10_000  # listed entries of an Arrow batch
HELD = 16 << 20  # bytes of contents of an Arrow batch
TASK_BYTES = 128 << 20  # bytes of contents that a task reads
ENTRY = pa.schema([("path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_())])
RAW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])


class Disk:
    """A folder of the machine or of a mount that all machines share.  Links to folders are not
    followed; what may not be read, or is gone by then, counts as not there."""

    def __init__(self, root: str):
        self.root = root

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int]]:
        try:
            with os.scandir(os.path.join(self.root, folder)) as listed:
                for e in listed:
                    if e.is_dir(follow_symlinks=False):
                        yield e.name, True, 0
                    elif e.is_file():
                        yield e.name, False, e.stat().st_size
        except (PermissionError, FileNotFoundError):
            return

    def read(self, path: str) -> bytes | None:
        try:
            with open(os.path.join(self.root, path), "rb") as f:
                return f.read()
        except (PermissionError, FileNotFoundError):
            return None


class Remote:
    """A folder of a store that Arrow opens by its address, in the tasks as in the driver."""

    def __init__(self, root: str):
        self.fs, self.root = arrow_fs.FileSystem.from_uri(root)

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int]]:
        at = f"{self.root}/{folder}".rstrip("/")
        for e in self.fs.get_file_info(arrow_fs.FileSelector(at, allow_not_found=True)):
            if e.type in (arrow_fs.FileType.File, arrow_fs.FileType.Directory):
                yield e.base_name, e.type == arrow_fs.FileType.Directory, e.size or 0

    def read(self, path: str) -> bytes | None:
        try:
            with self.fs.open_input_stream(f"{self.root}/{path}") as f:
                return f.read()
        except FileNotFoundError:
            return None


def opener(root: str) -> Callable[[], Disk | Remote] | None:
    """What opens the tree in a task; None for a store that only Spark's own readers reach."""
    scheme = re.match(r"([a-z][a-z0-9+.-]*):", root)
    if scheme is None or scheme[1] == "file":
        return functools.partial(Disk, re.sub(r"^file:(?://[^/]*)?", "", root) or "/")
    try:
        Remote(root).entries("")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    return functools.partial(Remote, root)


def below(tree: Disk | Remote, ignores: Callable[[str, bool], bool], folder: str, span: int = SPAN) -> Iterator[tuple[str, int, bool]]:
    """Path, size and False for files below ``folder`` that the rules leave; path, 0 and True for
    folders that were not opened because ``span`` entries had been listed."""
    left, seen = deque([folder]), 0
    while left and seen < span:
        at = left.popleft()
        for name, is_folder, size in tree.entries(at):
            seen += 1
            path = f"{at}/{name}" if at else name
            if any("\ud800" <= c <= "\udfff" for c in name) or ignores(path, is_folder):
                continue  # names that are no text cannot be stored
            if is_folder:
                left.append(path)
            else:
                yield path, size, False
    for path in left:
        yield path, 0, True


def listing(spark: SparkSession, opened: Callable[[], Disk | Remote], rules: IgnoreRules, span: int = SPAN) -> list[DataFrame]:
    """``path, length`` of the tree's files that the rules leave, one kept table for each round."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ignores = opened(), rules.matcher()
        rows: list[tuple[str, int, bool]] = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for row in below(tree, ignores, folder, span):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows))), schema=ENTRY)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows))), schema=ENTRY)

    folders, rounds = spark.createDataFrame([("",)], "path string").coalesce(1), []
    while True:
        seen = keep(folders.mapInArrow(step, "path string, length long, folder boolean"))
        rounds.append(seen)
        rest = seen.filter("folder").select("path")
        if rest.isEmpty():
            return rounds
        folders = rest.repartition(4 * spark.sparkContext.defaultParallelism)


def contents(opened: Callable[[], Disk | Remote], files: DataFrame) -> DataFrame:
    """``path, length, content`` of listed files, read by tasks of about ``TASK_BYTES`` each in batches
    of ``HELD`` bytes and at most one file more.  Files that are gone have no row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, rows, held = opened(), [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                content = tree.read(path)
                if content is not None:
                    rows.append((path, len(content), content))
                    held += len(content)
                    if held > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RAW.types)], schema=RAW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RAW.types)], schema=RAW)

    size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return files.select("path").repartition(int(tasks)).mapInArrow(read, "path string, length long, content binary")


def walk(spark: SparkSession, opened: Callable[[], Disk | Remote], rules: IgnoreRules, wanted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``path, length, content`` of the files that the rules leave and that ``wanted`` picks of the
    listing.  The picked listing is a kept step; contents are read whenever the result is."""
    rounds = listing(spark, opened, rules)
    files = functools.reduce(DataFrame.unionByName, [r.filter("NOT folder").select("path", "length") for r in rounds])
    chosen = keep(wanted(files))
    discard(*rounds)
    return contents(opened, chosen)
