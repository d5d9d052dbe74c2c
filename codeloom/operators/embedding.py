"""Embedders: anything with ``name``, ``size`` and ``embed``; the default needs no model, ``corpus`` learns
from the index itself."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions import text
from codeloom.operators.chunking import hashed_vector
from codeloom.operators.meaning import CorpusEmbedder

BATCH = 32


class Embedder(Protocol):
    name: str
    size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashedEmbedder:
    """Deterministic; near in words, not in meaning."""

    def __init__(self, size: int = 384):
        self.name, self.size = f"hashed-{size}", size

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [hashed_vector(t, self.size) for t in texts]


REGISTRY = {"hashed": HashedEmbedder, "corpus": CorpusEmbedder}


def build_embedder(engine: str = "hashed", **options) -> Embedder:
    """Unknown engines fall back to the default one."""
    return REGISTRY.get(engine, HashedEmbedder)(**options)


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """``chunk_id, path, embedding``; the embedder is loaded once for each Python worker's batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out: list[list[float]] = []
            for k in range(0, len(s), BATCH):
                part = s.iloc[k : k + BATCH].tolist()
                got = embedder.embed(part)
                if len(got) != len(part):
                    raise ValueError("the embedder returned another number of vectors")
                out += got
            yield pd.Series(out)

    return chunks.select("chunk_id", "path", run(text.embed_text(F.col("path"), F.col("symbols.name"), F.col("content"))).alias("embedding"))
