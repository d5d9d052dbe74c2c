"""Source trees as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.runtime import keep, ship
from codeloom.sources.ignore import ANYWHERE, EXTENSIONS, FOLDERS, IGNORE_FILES, IgnoreRules
from codeloom.sources.walk import opener, walk

MAX_KB = 512


TOGETHER = 10_000  # paths of a read
BATCH = 32 << 20  # bytes of hidden files that the driver holds at a time
RAW = "path string, length long, content binary"


class Tree:
    """A folder through Hadoop's file system, so any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.spark, self._path, self._io = spark, jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        at = self._path(root)
        self._fs = at.getFileSystem(hadoop)
        if not self._fs.exists(at):
            raise FileNotFoundError(root)
        self.root = self._fs.resolvePath(at).toString().rstrip("/")

    def read(self, path: str) -> bytes | None:
        at = self._path(f"{self.root}/{path}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(self._io.toByteArray(stream))
        finally:
            stream.close()

    def hidden(self, ignores: Callable[[str, bool], bool], folder: str = "", below: bool = False) -> Iterator[tuple[str, int]]:
        """Path and size of files that Spark's sources pass over: those that have, or lie in a
        folder that has, a name starting with a dot or an underscore.  Ignored folders are pruned."""
        for s in self._fs.listStatus(self._path(f"{self.root}/{folder}" if folder else self.root)):
            name = s.getPath().getName()
            path, secret = f"{folder}/{name}" if folder else name, below or name[0] in "._"
            if s.isDirectory():
                if not ignores(path, True):
                    yield from self.hidden(ignores, path, secret)
            elif secret and not ignores(path, False):
                yield path, s.getLen()


def read_rules(tree: Tree, folders: list[str]) -> IgnoreRules:
    """The ignore files at the root, each a list of rules of its own."""
    found = [tree.read(name) for name in IGNORE_FILES]
    return IgnoreRules([f.decode("utf-8", "replace").splitlines() for f in found if f is not None], folders)


def _hidden_rows(spark: SparkSession, tree: Tree, rules: IgnoreRules, most: int) -> list[DataFrame]:
    """Contents of hidden files of bounded size, a table for each batch of bounded bytes."""
    out, rows, held = [], [], 0
    for path, size in tree.hidden(rules.matcher()):
        if size <= most:
            rows.append((path, size, bytearray(tree.read(path) or b"")))
            held += size
            if held > BATCH:
                out.append(keep(spark.createDataFrame(rows, RAW)))
                rows, held = [], 0
    return [*out, spark.createDataFrame(rows, RAW)] if rows else out


def _through_spark(spark: SparkSession, tree: Tree, root: str, rules: IgnoreRules, most: int, wanted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For a store that only Spark's readers reach: a listing of all its files, then the picked ones,
    ``TOGETHER`` paths in a read, and the hidden ones through the driver, ``BATCH`` bytes at a time.
    Rules meet whole paths here, so one may take back what lies in an ignored folder."""
    address = r"^[a-z0-9+.-]+:(?://[^/]*)?"
    start = len(re.sub(address, "", tree.root)) + 2
    inside = F.substring(F.regexp_replace("path", address, ""), start, 1 << 20).alias("path")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    nested = F.col("path").rlike("(?:^|/)(?:" + "|".join(map(re.escape, ANYWHERE)) + ")/")
    chosen = keep(wanted(listed.select(F.col("path").alias("at"), inside, "length").filter(~rules.ignored(F.col("path")) & ~nested)).select("at"))
    rows, held = spark.createDataFrame([], RAW), []

    def opened(paths: list[str]) -> DataFrame:
        return spark.read.format("binaryFile").load([re.sub(r"([\\{}\[\]*?])", r"\\\1", x) for x in paths]).select(inside, "length", "content")

    for r in chosen.toLocalIterator():
        held.append(r["at"])
        if len(held) == TOGETHER:
            rows, held = rows.unionByName(opened(held)), []
    if held:
        rows = rows.unionByName(opened(held))
    for part in _hidden_rows(spark, tree, rules, most):
        rows = rows.unionByName(wanted(part))
    return rows


def scan(spark: SparkSession, root: str, folders: list[str] | None = None, extensions: list[str] | None = None, max_kb: int = MAX_KB, rules: IgnoreRules | None = None) -> DataFrame:
    """``path, hash, size, loc, language, content`` of the text files below ``root``.

    Tasks walk the tree and enter no ignored folder; sizes and endings are decided on the listing, and
    only the files that it leaves are opened, by tasks too.  Then files with a NUL or invalid UTF-8 near
    their start are left out as binary.  An ignored folder is not entered, so no rule takes back what
    lies in it.  An empty tree gives no rows."""
    ship(spark)
    tree = Tree(spark, root)
    rules = rules or read_rules(tree, FOLDERS if folders is None else folders)
    ends = [e.lstrip(".").lower() for e in (EXTENSIONS if extensions is None else extensions)]
    name = F.lower(text.basename(F.col("path")))
    ended = text.extension(F.col("path")).isin(ends) & ~name.isin(*IGNORE_FILES)

    def wanted(listed: DataFrame) -> DataFrame:
        return listed.filter(~ended & (F.col("length") <= max_kb * 1024))

    opened = opener(tree.root)
    rows = _through_spark(spark, tree, root, rules, max_kb * 1024, wanted) if opened is None else walk(spark, opened, rules, wanted)
    rows = rows.filter(~text.looks_binary(F.col("content")))
    rows = rows.select("path", F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return rows.select("path", "hash", "size", text.lines_of_code(F.col("content")).alias("loc"), text.language(F.col("path")).alias("language"), "content")
