"""Results in the shape that tools for agents return: one row with one VARIANT column ``result``.

Trims are part of the shape: 8 symbols and 1,500 characters a hit, 80 dependencies, 12 files.  What
cannot be answered is ``{"error": ...}``; symbols that cannot be read count as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.chunking import SYMBOL
from codeloom.plans.engine import Engine
from codeloom.sources.registry import Registry

HITS, SYMBOLS, CHARS, DEPENDENCIES, FILES = 20, 8, 1500, 80, 12


def symbols_of(raw: Column) -> Column:
    """Symbols of a JSON text: of a list of records, or of names alone (kind and line null); empty for
    anything else, so for null and broken texts."""
    each = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")

    def symbol(v: Column) -> Column:
        plain = F.schema_of_variant(v) == "STRING"
        name = F.when(plain, F.try_variant_get(v, "$", "string")).otherwise(F.try_variant_get(v, "$.name", "string"))
        return F.struct(F.try_variant_get(v, "$.kind", "string").alias("kind"), name.alias("name"), F.try_variant_get(v, "$.line", "int").alias("line"))

    return F.coalesce(F.filter(F.transform(each, symbol), lambda s: s["name"].isNotNull()), F.array().cast(f"array<{SYMBOL}>"))


def _variant(value: Column) -> Column:
    return F.parse_json(F.to_json(value, {"ignoreNullFields": "false"})).alias("result")


def _error(spark: SparkSession, message: str) -> DataFrame:
    return spark.range(1).select(_variant(F.struct(F.lit(message).alias("error"))))


def list_workspaces(spark: SparkSession, registry: Registry) -> DataFrame:
    rows = registry.frame(spark).select("id", "name", "path", "last_sync")
    return rows.agg(F.sort_array(F.collect_list(F.struct("id", "name", "path", "last_sync"))).alias("all")).select(_variant(F.col("all")))  # as many as were registered by hand


def search_code(engine: Engine, query: str, n: int = 8) -> DataFrame:
    hits = engine.search(query, max(1, min(n, HITS))).withColumn("place", F.monotonically_increasing_id())  # in order, and few
    names = F.slice(F.transform("symbols", lambda s: s["name"]), 1, SYMBOLS)
    shown = F.struct("path", F.concat_ws("-", "start_line", "end_line").alias("lines"), "score", names.alias("symbols"), F.substring("content", 1, CHARS).alias("content"))
    found = hits.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", shown.alias("hit")))), lambda h: h["hit"]).alias("results"))
    note = F.when(F.size("results") == 0, "no matches; use other words or sync again")
    return found.select(_variant(F.struct(F.lit(engine.store.manifest().get("repo")).alias("repo"), "results", note.alias("note"))))


def read_file(engine: Engine, root: str, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    try:
        w = engine.file_window(root, path, start, end or None, None)
    except ValueError as e:
        return _error(engine.spark, str(e))
    except Exception:  # whatever the file system says of a path that is not there
        return _error(engine.spark, "file not found")
    row = engine.spark.createDataFrame([(path, w["start"], w["end"], w["total"], w["content"])], "path string, start_line int, end_line int, total_lines int, content string")
    return row.select(_variant(F.struct(*row.columns)))


def repo_map(engine: Engine, max_nodes: int = 40) -> DataFrame:
    if engine.store.current() is None:
        return _error(engine.spark, "nothing has been synced yet")
    found = engine.repo_map(max_nodes)
    # bounded lists, each in its own order
    gathered = lambda df, order, *shown: df.agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct(*shown).alias("v")))), lambda x: x["v"]).alias("v"))
    modules = gathered(found["nodes"], [(-F.col("score")).alias("o"), F.col("id").alias("k")], "id", "files", "loc")
    links = gathered(found["links"].limit(DEPENDENCIES), [(-F.col("weight")).alias("o"), F.col("source").alias("a"), F.col("target").alias("b")], F.col("source").alias("from"), F.col("target").alias("to"))
    files = gathered(found["top_files"].limit(FILES), [(-F.col("score")).alias("o"), F.col("path").alias("k")], "path", "loc", "language")
    stats = found["stats"].select(F.struct("files", "loc", "modules").alias("stats"))
    whole = stats.crossJoin(modules.select(F.col("v").alias("modules"))).crossJoin(links.select(F.col("v").alias("dependencies"))).crossJoin(files.select(F.col("v").alias("top_files")))  # one row each
    return whole.select(_variant(F.struct(F.lit(engine.store.manifest().get("repo")).alias("repo"), "stats", "modules", "dependencies", "top_files")))


def get_symbols(engine: Engine, path: str) -> DataFrame:
    known = engine.table("files").filter(F.col("path") == path).select("path", "language").first()
    if known is None:
        return _error(engine.spark, "file not found")
    if known.language is None:
        return _error(engine.spark, "unsupported language")
    symbols = engine.symbols(path).agg(F.sort_array(F.collect_list(F.struct("line", "name", "kind"))).alias("s"))
    return symbols.select(_variant(F.struct(F.lit(path).alias("path"), F.lit(known.language).alias("language"), F.transform("s", lambda s: F.struct(s["kind"].alias("kind"), s["name"].alias("name"), s["line"].alias("line"))).alias("symbols"))))
