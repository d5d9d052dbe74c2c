"""Incremental maintenance: what changed, what is gone, what lacks vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(disk: DataFrame, known: DataFrame) -> DataFrame:
    """``path, status`` (new, modified, unchanged, deleted) of ``path, hash`` on both sides."""
    both = disk.select("path", F.col("hash").alias("now")).join(known.select("path", F.col("hash").alias("before")), "path", "full_outer")
    status = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("before"), "unchanged").otherwise("modified")
    return both.select("path", status.alias("status"))


def purge(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of a table by path without those of ``gone``."""
    return rows.join(gone.select("path").distinct(), "path", "left_anti")


def missing(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    return chunks.join(vectors.select(key), key, "left_anti")


def orphans(vectors: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    return vectors.join(chunks.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
