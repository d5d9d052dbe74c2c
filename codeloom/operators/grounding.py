"""Context for answers, citations, and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.runtime import keep

CONTEXT_CHARS, HISTORY, PARTS = 24_000, 6, 256
STAGES = ["indexing", "docs"]
PROBES = ["main", "app", "index", "cli", "server", "setup", "readme"]


def context_rows(ranked: DataFrame, most: int = CONTEXT_CHARS, by: str = "rank", group: list[str] = ()) -> DataFrame:
    """Ranked chunks within a budget of characters, the crossing one cut; blank ones count nothing.

    Where there are groups, lengths alone are added up first, in parts of a group and then over what
    no part shows to lie beyond the budget; only rows up to the last one within it meet as texts."""
    shown = ranked.filter(F.trim(F.regexp_replace("content", r"(?U)\s+", " ")) != "").withColumn("size__", F.length("content"))
    if group:
        small = _within(shown.select(*group, by, "size__"), most, by, [*group, F.pmod(F.xxhash64(by), F.lit(PARTS))])
        last = keep(_within(small.drop("used__"), most, by, group).groupBy(*(F.col(g).alias(f"{g}__") for g in group)).agg(F.max(by).alias("last__")))
        same = [F.col(g).eqNullSafe(F.col(f"{g}__")) for g in group]
        cut = shown.withColumn("content", F.substring("content", 1, most))
        shown = cut.join(last, [*same, F.col(by).isNull() | (F.col(by) <= F.col("last__"))]).drop("last__", *(f"{g}__" for g in group))
    rows = _within(shown, most, by, group)
    return rows.withColumn("content", F.expr(f"substring(content, 1, cast(greatest({most} - used__, 0) as int))")).drop("used__", "size__").filter(F.trim(F.regexp_replace("content", r"(?U)\s+", " ")) != "")


def _within(rows: DataFrame, most: int, by: str, group: list) -> DataFrame:
    """Rows before which less than ``most`` is used: ``used__``."""
    before = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("used__", F.coalesce(F.sum("size__").over(before), F.lit(0))).filter(F.col("used__") < most)


def render_context(rows: DataFrame, by: str = "rank") -> DataFrame:
    """One row, ``context``."""
    block = F.concat(F.lit("--- "), "path", F.lit(" (lines "), "start_line", F.lit("-"), "end_line", F.lit(") ---\n"), "content")
    parts = F.array_sort(F.collect_list(F.struct(F.col(by).alias("r"), block.alias("b"))))
    return rows.agg(F.array_join(F.transform(parts, lambda p: p["b"]), "\n\n").alias("context"))


def last_turns(turns: DataFrame, group: str, order: str, n: int = HISTORY) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    return turns.withColumn("r__", newest).filter(F.col("r__") <= n).drop("r__")


def messages(system: str, history: list[tuple[str, str]], context: str, question: str) -> list[dict[str, str]]:
    asked = f"Code context:\n\n{context}\n\nQuestion: {question}" if context else question
    return [{"role": "system", "content": system}, *({"role": r, "content": c} for r, c in history[-HISTORY:]), {"role": "user", "content": asked}]


def valid_citations(answers: DataFrame, content: str, context: DataFrame, key: str) -> DataFrame:
    """``key, path, line, ordinal`` of the citations whose path is in ``context``."""
    each = answers.select(key, F.posexplode(text.citations(F.col(content))).alias("ordinal", "c")).select(key, "ordinal", "c.path", "c.line")
    return each.join(context.select("path").distinct(), "path", "left_semi")


def cost_summary(costs: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """``stage, calls, tokens, cost_usd`` with every stage, sums of nothing being 0."""
    sums = costs.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd"))
    listed = costs.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    return listed.join(sums, "stage", "left").select("stage", F.coalesce("calls", F.lit(0)).cast("long").alias("calls"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.round(F.coalesce("cost_usd", F.lit(0.0)), 6).alias("cost_usd"))


def is_entry_point(path: Column) -> Column:
    return F.lower(text.basename(path)).rlike("|".join(PROBES))


def onboarding_files(files: DataFrame, first: int = 40, most: int = 14) -> DataFrame:
    """``path, place``: entry points among the largest files, filled up with the highest ranked."""
    large = files.orderBy(F.desc("loc"), "path").limit(first).filter(is_entry_point(F.col("path"))).select("path", F.lit(0).alias("leg"), (-F.col("loc")).cast("double").alias("by"))
    high = files.orderBy(F.desc("score"), "path").limit(20).select("path", F.lit(1).alias("leg"), (-F.col("score")).alias("by"))
    one = large.union(high).groupBy("path").agg(F.min(F.struct("leg", "by")).alias("k"))
    return one.select("path", F.row_number().over(Window.orderBy("k.leg", "k.by", "path")).alias("place")).filter(F.col("place") <= most)
