"""Gives executors the library's code."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_shipped: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session, once for each application, and bounds
    the rows of an Arrow batch where the session leaves that at its default."""
    if spark.conf.get(BATCH, "10000") == "10000":  # Spark's default: too many for long texts
        spark.conf.set(BATCH, "1000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="codeloom-code-")) / "codeloom_code.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, f"{package.name}/{p.relative_to(package)}")
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, run after its code has been sent."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; where none is set, a temporary one on a
    single machine, and an error on a cluster, whose executors would each write to their own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Writes a step's rows to the shared folder and reads them again: cuts the lineage, survives
    lost executors, and fixes what later steps see."""
    at = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.kept_at = at
    return out


def keep_counted(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """``keep``, and aggregates of the rows taken while they are written.

    They are observed in the stage that writes, whose tasks count once however often they are tried,
    so that lost executors do not count rows twice.  Aggregates of no rows are as Spark defines them."""
    seen = Observation()
    kept = keep(df.observe(seen, *[c.alias(name) for name, c in figures.items()]))
    return kept, dict(seen.get)


def discard(*kept: DataFrame) -> None:
    """Deletes steps that ``keep`` returned and that no later result reads."""
    for df in kept:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
