"""Similarity of vectors, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine distance."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Place between ``low`` and ``high``; a half where they are the same."""
    return F.when(high - low < 1e-9, F.lit(0.5)).otherwise((value - low) / (high - low))
