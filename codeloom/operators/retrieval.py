"""Lexical, vector and hybrid retrieval."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import porter, similarity, text
from codeloom.runtime import keep

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
LEXICAL, VECTOR, RRF, BOOST = 40, 24, 60, 0.02


def query_phrases(query: str, stem=None) -> list[list[str]]:
    """The phrases of a query: all its words in a row, then each word; words with inner marks are
    phrases themselves.  Terms that could be operators of a query language are plain terms."""
    words = [w for w in re.sub(r"[^\w\s.]", " ", query).split() if len(w) >= 2]
    split = [[t if stem is None else stem(t) for t in re.findall(r"[^\W_]+", w.lower())] for w in words]
    split = [s for s in split if s]
    whole = [t for s in split for t in s]
    return ([whole] if len(words) > 1 and len(whole) > 1 else []) + split[: 12 - (len(words) > 1)]


def phrase_frequency(joined: Column, phrase: list[str]) -> Column:
    """How often the phrase stands in terms joined by blanks, a blank at either end."""
    rest = "".join(f" {t}" for t in phrase[1:])
    return F.regexp_count(joined, F.lit(f" {phrase[0]}(?={rest} )"))


def idf(n: float, df: float) -> float:
    value = math.log((n - df + 0.5) / (df + 0.5))
    return value if value > 0 else LEAST_IDF


def bm25(docs: DataFrame, key: str, content: str, phrases: list[list[str]], limit: int | None = LEXICAL) -> DataFrame:
    """``key, score`` by a scan: one pass over the texts keeps lengths and frequencies, from which
    the corpus figures (one row) and the scores follow."""
    joined = text.joined_terms(F.col(content))
    blanks = F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit("")))
    length = F.when(F.length(joined) > 2, blanks - 1).otherwise(F.lit(0) * blanks)
    measured = keep(docs.select(key, length.alias("dl"), *(phrase_frequency(joined, p).alias(f"f{i}") for i, p in enumerate(phrases))))
    figures = measured.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"f{i}") for i in range(len(phrases)))).first()
    if not figures.n or not phrases:
        return measured.select(key, F.lit(0.0).alias("score")).limit(0)
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(figures.avgdl or 1.0))
    score = sum((F.lit(idf(figures.n, figures[f"f{i}"])) * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + norm) for i in range(len(phrases))), F.lit(0.0))
    hit = measured.filter(" or ".join(f"f{i} > 0" for i in range(len(phrases)))).select(key, score.alias("score"))
    return hit.orderBy(F.desc("score"), key).limit(limit) if limit else hit


def postings(docs: DataFrame, key: str, content: str, stemmed: bool = False, terms: list[str] | None = None) -> DataFrame:
    """``term, key, tf, positions, dl``: the inverted index; sort by term when it is written.

    ``stemmed``: of folded terms' Porter stems.  Words are grouped before they are stemmed, and only
    the vocabulary is: each distinct word once for a task's batch, not running text.
    ``terms``: the rows of these terms alone.  Their spellings are looked up in the vocabulary of
    their first letters, so that no other word of a text is grouped or sent."""
    tokens = docs.select(key, text.analyze(F.col(content)).alias("tokens"))
    each = tokens.select(key, F.size("tokens").alias("dl"), F.posexplode("tokens").alias("pos", "term"))
    stem = porter.porter_stem(text.folded(F.col("term")))  # folding moves no end of a term, so it can wait for the vocabulary
    if stemmed and terms is not None:
        # no step of the stemmer or of folding changes a term's first letter but for its diacritics
        first = {t[:1] for t in terms} | {k for k, plain in zip(*text.FOLDED, strict=True) if plain in {t[:1] for t in terms}}
        each = keep(each.filter(F.substring("term", 1, 1).isin(sorted(first))))
        wanted = keep(each.select("term").distinct().withColumn("stem", stem).filter(F.col("stem").isin(terms)))
        each = each.join(F.broadcast(wanted), "term").select(F.col("stem").alias("term"), key, "dl", "pos")  # few: suffixes are a fixed list
    elif terms is not None:
        each = each.filter(F.col("term").isin(terms))
    if not stemmed or terms is not None:
        return each.groupBy("term", key, "dl").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    spelled = each.groupBy("term", key, "dl").agg(F.collect_list("pos").alias("positions")).withColumn("term", stem)
    joined = spelled.groupBy("term", key, "dl").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return joined.select("term", key, "dl", F.size("positions").alias("tf"), "positions")


def fold(word: str) -> str:
    """A word as ``text.folded`` leaves it."""
    return word.lower().translate(str.maketrans(*text.FOLDED))


def stemmed_phrases(query: str) -> list[list[str]]:
    """``query_phrases`` in the terms of a stemmed index."""
    return query_phrases(query, lambda w: porter.stem(fold(w)))


def bm25_indexed(index: DataFrame, figures: tuple[int, float], key: str, phrases: list[list[str]], limit: int | None = LEXICAL) -> DataFrame:
    """``key, score`` from postings; the terms reach the scan as a filter.  ``figures``: documents
    and their average length."""
    n, average = figures
    words = sorted({t for p in phrases for t in p})
    if not n or not words:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    rows = index.filter(F.col("term").isin(words)).groupBy(key, "dl").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))

    def frequency(phrase: list[str]) -> Column:
        first = F.coalesce(F.try_element_at(F.col("at"), F.lit(phrase[0])), F.array().cast("array<int>"))
        for k, t in enumerate(phrase[1:], 1):
            other = F.coalesce(F.try_element_at(F.col("at"), F.lit(t)), F.array().cast("array<int>"))
            first = F.array_intersect(first, _shifted(other, k))
        return F.size(first)

    rows = rows.select(key, "dl", *(frequency(p).alias(f"f{i}") for i, p in enumerate(phrases)))
    df = rows.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"f{i}") for i in range(len(phrases)))).first()
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(average or 1.0))
    score = sum((F.lit(idf(n, df[f"f{i}"])) * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + norm) for i in range(len(phrases))), F.lit(0.0))
    hit = rows.filter(" or ".join(f"f{i} > 0" for i in range(len(phrases)))).select(key, score.alias("score"))
    return hit.orderBy(F.desc("score"), key).limit(limit) if limit else hit


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def nearest(vectors: DataFrame, key: str, embedding: str, query: list[float], limit: int = VECTOR, where: Column | None = None) -> DataFrame:
    """``key, score``: exact cosine search, filtered before it is ranked."""
    rows = vectors if where is None else vectors.filter(where)
    score = similarity.cosine(F.col(embedding), F.array(*(F.lit(float(x)) for x in query)))
    return rows.filter(F.col(embedding).isNotNull()).select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(limit)


def fuse(legs: list[tuple[str, DataFrame]], key: str, k: int = RRF) -> DataFrame:
    """Reciprocal rank fusion: ``key, score, sources, vector_score, leg, place``.

    The legs are limited lists, so their ranks are cheap; union and one aggregation, no outer join."""
    parts = []
    for i, (name, leg) in enumerate(legs):
        rank = F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1
        parts.append(leg.withColumn("place", rank).select(key, F.lit(name).alias("source"), F.lit(i).alias("leg"), "place", (1.0 / (F.lit(k) + F.col("place") + 1)).alias("part"), F.when(F.lit(name == "vector"), F.col("score")).alias("vector_score")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(key).agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"), F.coalesce(F.max("vector_score"), F.lit(0.0)).alias("vector_score"), F.min(F.struct("leg", "place")).alias("first")).select(key, "score", "sources", "vector_score", "first.leg", "first.place")


def boost_definitions(fused: DataFrame, names: Column, query: str) -> DataFrame:
    """Adds to the score where a symbol's name is a word of the query."""
    terms = [w for w in query.lower().replace("(", " ").replace(")", " ").split() if len(w) >= 3]
    hit = F.arrays_overlap(F.transform(names, F.lower), F.array(*map(F.lit, terms))) if terms else F.lit(False)
    return fused.withColumn("score", F.col("score") + F.when(F.coalesce(hit, F.lit(False)), BOOST).otherwise(0.0))


def ranked(fused: DataFrame, key: str, limit: int) -> DataFrame:
    return fused.orderBy(F.desc("score"), F.desc("vector_score"), "leg", "place", key).limit(limit).withColumn("score", F.round("score", 4))
