"""Table functions for SQL: ``SELECT ... FROM files, LATERAL chunk_file(path, language, content)``.

Rows travel pickled, many at a time: with Arrow each call would make a batch of its own, since a
lateral call's rows belong to one file.  A null language or content gives no rows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from codeloom.operators import chunking


@udtf(returnType=f"ordinal int, start_line int, end_line int, symbols array<{chunking.SYMBOL}>, content string", useArrow=False)
class ChunkFile:
    def eval(self, language: str, content: str):
        if language is not None and content is not None:
            for k, (a, b, text, symbols) in enumerate(chunking.chunk_file(content, language)):
                yield k, a, b, [tuple(s) for s in symbols], text


@udtf(returnType="kind string, name string, line int", useArrow=False)
class FileSymbols:
    def eval(self, language: str, content: str):
        if language is not None and content is not None:
            yield from chunking.extract_symbols(content, language)


def register(spark: SparkSession) -> None:
    """``chunk_file(language, content)``, ``file_symbols(language, content)``, and ``fts_query(text)``,
    which is expanded into the plan."""
    spark.udtf.register("chunk_file", ChunkFile)
    spark.udtf.register("file_symbols", FileSymbols)
    words = r"filter(split(regexp_replace(q, r'(?U)[^\w\s.]', ' '), r'(?U)\s+'), w -> length(w) >= 2)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fts_query(q STRING) RETURNS STRING RETURN (SELECT array_join(slice(CASE WHEN size(w) > 1 THEN concat(array('\"' || array_join(w, ' ') || '\"'), w) ELSE w END, 1, 12), ' OR ') FROM (SELECT {words} AS w))")
