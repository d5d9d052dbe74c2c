"""A corpus pipeline of four stages: toxicity, near duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents``, works on all rows that
the one before kept, and returns the same columns; the last returns the packed pieces.  ``run``
writes every stage as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm import common
from codeloom.llm.components import join_hot
from codeloom.llm.op4_jaccard import Filter, near_duplicates
from codeloom.llm.op6_toxicity import learned, score_texts
from codeloom.llm.op7_pii import sanitise
from codeloom.llm.op9_packing import pack_documents
from codeloom.runtime import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below 0.5.  Null and empty texts are scored like others; repeated
    rows score alike and stay or go together; an empty table stays empty."""
    ship(spark)
    return score_texts(docs, learned(spark, sf_dir), out="toxicity__").filter("toxicity__ < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: that of the smallest id, and of rows with this
    id the one of the least text key.  Rows that share an id but no class are not thinned out.
    Documents without words, or without an id, all stay; an empty table stays empty."""
    ship(spark)
    classes = common.keep(near_duplicates(docs.select("doc_id", "text")).filter(F.col("class_key").isNotNull() & F.col("doc_id").isNotNull()))
    each = classes.select("class_key", "doc_id", "text_key").distinct()
    first = common.keep(each.groupBy("class_key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("many")))
    go = join_hot(each, first, ["class_key"], "many").filter(F.struct("doc_id", "text_key") != F.col("first")).select("doc_id", "text_key").distinct()
    twice = classes.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "text_key")
    keyed = docs.withColumns({"doc_key__": F.col("doc_id").cast("long"), "text_key__": F.xxhash64("text")})
    keys = [F.col("doc_id").alias("doc_key__"), F.col("text_key").alias("text_key__")]
    # most rows neither go nor repeat: only the texts of the others are sent
    keyed = Filter(go.unionByName(twice), ["doc_id", "text_key"]).marked(keyed, "some__", "doc_key__", "text_key__")
    left = common.keep(keyed.filter("some__").join(go.select(*keys), ["doc_key__", "text_key__"], "left_anti").select(*keyed.columns))
    # rows that repeat both id and text: the least by all columns
    again = left.join(twice.select(*keys), ["doc_key__", "text_key__"], "left_semi").groupBy("doc_key__", "text_key__").agg(F.min(F.struct(*docs.columns)).alias("row"))
    once = left.join(twice.select(*keys), ["doc_key__", "text_key__"], "left_anti")
    return keyed.filter("not some__").unionByName(once).select(*docs.columns).unionByName(again.select("row.*"))


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data and removes terms that reveal it; ``n_chars`` follows the text.  All
    rows stay, repeated ones too; null texts stay null, empty ones empty."""
    ship(spark)
    out = sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens, each row for itself; a null or empty
    text is its end token; an empty table gives no pieces."""
    ship(spark)
    return pack_documents(docs.select("doc_id", "text"), common.default_tokenizer())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", sanitise_personal_data), ("packing", pack)]

ORACLE_SQL = None  # toxicity and packing cannot be put in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.keep(stage(spark, docs, sf_dir))
    return docs
