"""Versioned snapshots, copied on write.

A table lies in buckets: ``data/<table>/run=<id>/bucket=<n>``.  A version is a manifest that names the
folder of each bucket of each table, and one small pointer file says which version is current.  A new
version writes the buckets that changed and names the old folders for the rest, so a sync without
changes writes no data.  Readers resolve the pointer once and then see one version; old versions stay
readable until ``vacuum`` deletes what no version that is left names.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER, BUCKET = "_CURRENT", "bucket"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _read(self, name: str) -> str | None:
        at = self._path(f"{self.root}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(b & 0xFF for b in self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Written aside, then renamed over what is there in one step, where the file system has it:
        a reader sees the old file or the new one, and a crash leaves one of them."""
        aside, at = self._path(f"{self.root}/.{name.replace('/', '_')}-{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        self._fs.mkdirs(at.getParent())
        stream = self._fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        over = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        how = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = over
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(at).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(at), how)

    def current(self) -> str | None:
        text = self._read(POINTER)
        return json.loads(text)["version"] if text else None

    def manifest(self) -> dict:
        version = self.current()
        return json.loads(self._read(f"{version}/manifest.json") or "{}") if version else {}

    def tables(self, version: str | None = None) -> dict:
        """Schema and bucket folders of a version's tables."""
        version = version or self.current()
        return json.loads(self._read(f"{version}/manifest.json") or "{}").get("tables", {}) if version else {}

    def read(self, name: str, version: str | None = None, only: set[int] | None = None, bucket: bool = False) -> DataFrame | None:
        """A table of a version, or only some of its buckets; with ``bucket`` as a column."""
        return self.frame(self.tables(version), name, only, bucket)

    def frame(self, tables: dict, name: str, only: set[int] | None = None, bucket: bool = False) -> DataFrame | None:
        if name not in tables:
            return None
        schema = T.StructType.fromJson(tables[name]["schema"])
        at = [f"{self.root}/data/{name}/{where}" for n, where in sorted(tables[name]["parts"].items()) if only is None or int(n) in only]
        whole = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField(BUCKET, T.IntegerType())])
        columns = [*schema.names, BUCKET] if bucket else schema.names
        if not at:
            return self.spark.createDataFrame([], whole).select(*columns)
        return self.spark.read.schema(whole).option("basePath", f"{self.root}/data/{name}").parquet(*at).select(*columns)

    def stage(self, tables: dict, changes: dict[str, tuple[DataFrame, set[int] | None]], sort: dict[str, list[str]] | None = None) -> dict:
        """Writes changed buckets; the tables with them, which ``publish`` makes a version.

        A change is rows with a ``bucket`` column, and the buckets that they replace: a set, all of whose
        buckets become these rows, or None for the whole table.  Large buckets are split over tasks."""
        def one(name: str, rows: DataFrame, touched: set[int] | None) -> dict:
            schema = T.StructType([f for f in rows.schema.fields if f.name != BUCKET])
            parts = {} if touched is None else {n: where for n, where in tables.get(name, {"parts": {}})["parts"].items() if int(n) not in touched}
            if touched is None or touched:
                run = f"run={uuid.uuid4().hex}"
                rows.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, *(sort or {}).get(name, [])).write.partitionBy(BUCKET).parquet(f"{self.root}/data/{name}/{run}")
                for folder in self._folders(f"data/{name}/{run}"):  # one for each bucket at most
                    if folder.startswith(f"{BUCKET}="):
                        parts[folder.partition("=")[2]] = f"{run}/{folder}"
            return {"schema": schema.jsonValue(), "parts": parts}

        with ThreadPoolExecutor(max(1, len(changes))) as pool:  # the tables' jobs run beside each other
            begun = {name: pool.submit(inheritable_thread_target(self.spark)(one), name, rows, touched) for name, (rows, touched) in changes.items()}
            return {**tables, **{name: job.result() for name, job in begun.items()}}

    def publish(self, tables: dict, manifest: dict) -> str:
        """Makes staged tables a version and moves the pointer; a failure before leaves the old one current."""
        version = f"v-{uuid.uuid4().hex}"
        self._write(f"{version}/manifest.json", json.dumps({**manifest, "tables": tables}))
        self._write(POINTER, json.dumps({"version": version}))
        return version

    def versions(self) -> list[str]:
        """All versions, the newest first."""
        if not self._fs.exists(self._path(self.root)):
            return []
        found = [(s.getModificationTime(), s.getPath().getName()) for s in self._fs.listStatus(self._path(self.root))]
        now = self.current()
        return sorted((n for _, n in sorted(found, reverse=True) if n.startswith("v-")), key=lambda n: n != now)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the current version and the newest besides, ``keep`` in all, and then the
        buckets that none of these names; the number of versions deleted."""
        versions = self.versions()
        for v in versions[keep:]:
            self._fs.delete(self._path(f"{self.root}/{v}"), True)
        named = {f"{name}/{where}" for v in versions[:keep] for name, t in self.tables(v).items() for where in t["parts"].values()}
        for folder in self._folders("data"):
            for run in self._folders(f"data/{folder}"):
                held = self._folders(f"data/{folder}/{run}")
                gone = [b for b in held if f"{folder}/{run}/{b}" not in named]
                for b in [""] if len(gone) == len(held) else gone:
                    self._fs.delete(self._path(f"{self.root}/data/{folder}/{run}/{b}".rstrip("/")), True)
        return len(versions[keep:])

    def _folders(self, at: str) -> list[str]:
        where = self._path(f"{self.root}/{at}")
        return [s.getPath().getName() for s in self._fs.listStatus(where) if s.isDirectory()] if self._fs.exists(where) else []

    def data_files(self) -> int:
        """Number of data files of all versions."""
        return sum(s.getPath().getName().startswith("part-") for name in self._folders("data") for run in self._folders(f"data/{name}") for b in self._folders(f"data/{name}/{run}") for s in self._fs.listStatus(self._path(f"{self.root}/data/{name}/{run}/{b}")))

    def append(self, name: str, rows: DataFrame) -> None:
        """Append-only tables outside versions (costs)."""
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def log(self, name: str) -> DataFrame | None:
        at = f"{self.root}/{name}"
        return self.spark.read.parquet(at) if self._fs.exists(self._path(at)) else None

    def put(self, name: str, value: dict) -> None:
        self._write(f"{name}.json", json.dumps(value))

    def get(self, name: str, default: dict | None = None) -> dict:
        """A small value; a broken one counts as missing."""
        try:
            return json.loads(self._read(f"{name}.json") or "null") or (default or {})
        except ValueError:
            return default or {}


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def rank_latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")
