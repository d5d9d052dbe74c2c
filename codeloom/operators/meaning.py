"""Vectors near in meaning, trained on the indexed texts alone.

Words are counted beside each other within a window; the counts become positive pointwise mutual
information, a sparse symmetric matrix by term, and a randomised eigendecomposition of it gives each
term a vector: words that stand in like company lie near each other though they never meet.  A text's
vector is the sum of its terms', weighted by ``(1 + ln tf) * idf``, at length 1.

The matrix and the term vectors stay tables.  Products of the matrix with a block of vectors are a
join and sums with partial aggregation, so a word that stands beside all others is no hot group; only
Gram matrices of ``size + OVER`` rows, added up by task, reach the driver.  The first block comes from
a hash of each term, so a run gives the same vectors as another, but for the rounding of sums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import retrieval
from codeloom.operators.pairs import Pairs
from codeloom.runtime import discard, keep

WINDOW, SIZE, OVER, ROUNDS = 4, 64, 8, 2


def ppmi(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """``a, b, n, ppmi`` in both directions, where that is above 0; ``tokens``: one array a text.

    ``n`` counts how often the two stand near each other over all texts; null and empty texts add none."""
    return Pairs(tokens, window).rows()


def company(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """``term, company, n, ppmi``: over the rows of ``ppmi`` with this ``a`` their number, and the sums
    of ``n`` and of ``ppmi`` at six places; no row is made for them."""
    return Pairs(tokens, window).sums()


def _numbers(x: pd.Series, k: int) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(np.float64).reshape(-1, k) if len(x) else np.zeros((0, k))


def _start(terms: DataFrame, k: int) -> DataFrame:
    """``term, x``: normal numbers that follow from the term."""

    def run(batches):
        for b in batches:
            seeds = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") for t in b["term"]]
            yield pd.DataFrame({"term": b["term"], "x": [np.random.default_rng(s).standard_normal(k).tolist() for s in seeds]})

    return terms.mapInPandas(run, "term string, x array<double>")


def _times(entries: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """The matrix times a block of ``k`` columns."""
    met = entries.join(block.withColumnRenamed("term", "b"), "b")
    return met.groupBy(F.col("a").alias("term")).agg(F.array(*(F.sum(F.col("ppmi") * F.get("x", F.lit(i))) for i in range(k))).alias("x"))


def _gram(pairs: DataFrame, left: str, right: str, k: int) -> np.ndarray:
    """Sum over rows of ``left`` times ``right``, by task and then by place."""

    def run(batches):
        total = np.zeros((k, k))
        for b in batches:
            total += _numbers(b[left], k).T @ _numbers(b[right], k)
        yield pd.DataFrame({"at": np.arange(k * k), "v": total.ravel()})

    out = np.zeros(k * k)
    for r in pairs.select(left, right).mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r.at] = r.v
    return out.reshape(k, k)


def _turned(block: DataFrame, by: np.ndarray, k: int) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"term": b["term"], "x": (_numbers(b["x"], k) @ by).tolist()})

    return block.mapInPandas(run, "term string, x array<double>")


def _orthonormal(block: DataFrame, k: int) -> tuple[DataFrame, int]:
    """Columns at right angles that span the same; fewer where the rank is less."""
    block = keep(block)
    gram = _gram(block.withColumn("y", F.col("x")), "x", "y", k)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > max(values[-1], 0) * 1e-12
    if not good.any():
        return block.limit(0), 0
    out = keep(_turned(block, vectors[:, good] / np.sqrt(values[good]), k))
    discard(block)
    return out, int(good.sum())


def term_vectors(entries: DataFrame, size: int = SIZE, over: int = OVER, rounds: int = ROUNDS) -> DataFrame:
    """``term, x``: for each term of ``a, b, ppmi`` at most ``size`` numbers, the eigenvectors of the
    largest positive eigenvalues by the root of these."""
    k = size + over
    block, k = _orthonormal(_times(entries, _start(entries.select(F.col("a").alias("term")).distinct(), k), k), k)
    for _ in range(rounds if k else 0):
        before, (block, k) = block, _orthonormal(_times(entries, block, k), k)
        discard(before)
    if not k:
        return block
    after = _times(entries, block, k).withColumnRenamed("x", "y")
    small = _gram(block.join(after, "term"), "x", "y", k)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    best = [i for i in np.argsort(-values)[:size] if values[i] > 0]
    return _turned(block, vectors[:, best] * np.sqrt(values[best]), k)


class CorpusEmbedder:
    """Learns from the chunks when an index is built; its table of terms is stored with the snapshot."""

    trained = True

    def __init__(self, size: int = SIZE, window: int = WINDOW):
        self.name, self.size, self.window = f"corpus-{size}-{window}", size, window

    def fit(self, chunks: DataFrame) -> DataFrame:
        """``term, idf, vector`` of the chunks' words."""
        tokens = keep(chunks.select("chunk_id", text.index_terms(F.col("content")).alias("tokens")))
        entries = keep(ppmi(tokens.select("tokens"), self.window).select("a", "b", "ppmi"))
        n = tokens.count()
        df = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        padded = F.concat("x", F.array_repeat(F.lit(0.0), F.lit(self.size) - F.size("x")))
        out = keep(term_vectors(entries, self.size).join(df, "term").select("term", F.log1p(F.lit(float(n)) / F.col("df")).alias("idf"), padded.alias("vector")))
        discard(tokens, entries)
        return out

    def embed_chunks(self, chunks: DataFrame, model: DataFrame) -> DataFrame:
        """``chunk_id, path, embedding``; a chunk whose words are all unknown gets zeros."""
        words = F.explode_outer(text.index_terms(F.concat_ws(" ", F.col("path"), F.col("content")))).alias("term")
        counted = chunks.select("chunk_id", "path", words).groupBy("chunk_id", "path", "term").agg(F.count("*").alias("tf"))
        weight = (1 + F.log("tf")) * F.col("idf")
        met = counted.join(model, "term", "left").withColumn("w", weight)
        sums = met.groupBy("chunk_id", "path").agg(F.array(*(F.coalesce(F.sum(F.col("w") * F.get("vector", F.lit(i))), F.lit(0.0)) for i in range(self.size))).alias("x"))
        norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
        scaled = F.zip_with("x", F.array_repeat(norm, self.size), lambda v, n: F.when(n > 0, v / n).otherwise(F.lit(0.0)))
        return sums.select("chunk_id", "path", scaled.cast("array<float>").alias("embedding"))

    def embed_query(self, model: DataFrame, query: str) -> list[float]:
        """Reads the query's own terms only; zeros where none is known."""
        words = sorted({t for phrase in retrieval.query_phrases(query, retrieval.fold) for t in phrase})
        known = model.filter(F.col("term").isin(words)).select("idf", "vector").collect() if words else []
        x = sum((np.array(r.vector) * r.idf for r in known), np.zeros(self.size))
        norm = float(np.sqrt(x @ x))
        return (x / norm).tolist() if norm else x.tolist()
