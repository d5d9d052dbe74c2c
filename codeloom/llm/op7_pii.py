"""Operator 7: personal data by information-theoretic sanitisation, in DataFrame functions only.

Protected entities are the values of four base patterns: e-mail addresses, IP addresses, payment card
numbers and phone numbers.  The corpus then tells which words reveal them: the terms are all words
outside base spans, and all counts are of documents: those that hold the entity, those that hold the
term, and those that hold both, wherever they stand.  Copies raise all three alike, so they neither hide nor
thin out a disclosure.  With ``IC(e) = -log2 p(e)`` and ``PMI(t; e) = log2 p(t, e) / (p(t) p(e))`` a
term discloses an entity when ``PMI >= ALPHA * IC(e)`` and the two stand together in ``MIN_DOCS``
documents at least: in the only document of an entity every word that occurs once would reach IC.
Such terms are removed in documents that hold the entity; base spans are generalised to their kind.

Counts are pre-aggregated sums and frequent entities are joined by ``join_hot``, so neither a frequent
word nor an entity that a third of all rows hold gathers in one task.  A document is changed where it
holds the entity itself.  Null texts are empty; repeated rows are kept and treated alike; an empty
table gives no rows; other columns are ignored (``sanitise`` keeps them, whatever their names).  In very
long texts, positions and pieces are found by stretches of ``STRETCH`` matches, so that work does not
grow with the square of the matches of a text.

The patterns are the stated ones, written so that Java neither recurses nor tries a run of characters
again from each of its places: possessive repeats, starts only where a run starts or the last match
ended, and for cards the number of digits within the pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import common
from codeloom.llm.components import join_hot

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
ALPHA, MIN_DOCS, STRETCH = 0.8, 2, 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stretches(array: Column, more: int = 0) -> Column:
    """Slices of ``STRETCH`` elements, each with ``more`` of the next one's; one at least."""
    many = F.greatest(F.ceil(F.size(array) / STRETCH).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(1), many), lambda k: F.slice(array, (k - 1) * STRETCH + 1, F.lit(STRETCH + more)))


def before(values: Column, most: bool = False) -> Column:
    """For each of ``array<int>`` the sum (or the largest, 0 at least) of those before it."""
    fold = (lambda a, v: F.greatest(a, v)) if most else (lambda a, v: a + v)

    def each(part: Column, first: Column) -> Column:
        return F.transform(part, lambda v, i: F.aggregate(F.slice(part, F.lit(1), i), first, fold))

    def of(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), fold))
        return F.flatten(F.zip_with(parts, let(totals, lambda t: each(t, F.lit(0))), each))

    return let(values, lambda held: let(stretches(held), of))


def pieces(text: Column, cuts: Column) -> Column:
    """What lies between each two neighbours of the ascending places ``cuts``."""

    def within(part: Column) -> Column:
        first = F.get(part, F.lit(0))
        held = F.substring(text, first + 1, F.element_at(part, -1) - first)
        return let(held, lambda h: F.transform(F.slice(part, F.lit(1), F.size(part) - 1), lambda c, i: F.substring(h, c - first + 1, F.get(part, i + 1) - c)))

    return F.flatten(F.transform(stretches(cuts, 1), within))


def matches(text: Column, pattern: Column, rank: int, kind: str) -> Column:
    """Spans of all matches in ``text``, from the lengths of matches and of what lies between."""

    def span(m: Column, end: Column) -> Column:
        return F.struct((end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), m.alias("value"))

    def spans(found: Column, steps: Column) -> Column:
        return F.zip_with(found, F.zip_with(before(steps), steps, lambda a, b: a + b), span)

    def of(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        steps = F.zip_with(found, between, lambda m, b: F.length(b) + F.length(m))
        return F.when(F.size(found) > 0, let(steps, lambda x: spans(found, x))).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), of)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(digits(value)), ""), lambda d: d != ""), lambda d, i: F.when(i % 2 == 1, (2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10)).otherwise(d.cast("int")).cast("int"))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & F.forall(F.split(v, r"\."), lambda p: F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 3, "0") <= "255"),
    "card": luhn,
    "phone": lambda v: F.length(digits(v)).between(9, 15),
}


def _valid(kind: str):
    return lambda s: VALID[kind](s["value"])


def _of(kind: str):
    return lambda s: s["kind"] == kind


def base_spans(text: Column) -> Column:
    """All valid base spans by start, then kind."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    parts = [F.when(F.regexp_like(text, F.lit(NEEDS[k])), F.filter(matches(text, F.lit(PATTERNS[k]), i, k), _valid(k))).otherwise(none) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def past(spans: Column) -> Column:
    """How far the spans before each reach."""
    return before(F.transform(spans, lambda s: s["end"]), most=True)


def gaps(text: Column, spans: Column) -> Column:
    """The pieces of ``text`` before each of ``spans`` (by start), outside all of them, and the rest."""
    cuts = F.flatten(F.zip_with(spans, past(spans), lambda s, p: F.array(p, F.greatest(s["start"], p))))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    every = let(F.concat(cuts, F.array(last, F.length(text))), lambda c: pieces(text, c))
    return F.filter(every, lambda _, i: i % 2 == 0)


def outside(text: Column, base: Column) -> Column:
    """The text with a space in place of each base span."""
    return F.when(F.size(base) > 0, F.array_join(gaps(text, base), " ")).otherwise(text)


def terms(text: Column) -> Column:
    """Distinct words of letters, lower-case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != ""))


def entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(digits(span["value"])))


def disclosing(holders: DataFrame, docs: DataFrame) -> DataFrame:
    """``entity, term`` pairs over the threshold; ``holders``: ``row_key, terms, entities`` of the
    documents with entities, ``docs``: ``terms`` of all documents."""
    held = holders.select("row_key", F.explode("entities").alias("entity"))
    # entities of one document cannot reach MIN_DOCS; the rest are counted before any word is paired with them
    times = common.keep(held.groupBy("entity").agg(F.count("*").alias("times")).filter(F.col("times") >= MIN_DOCS))
    several = join_hot(held, times, ["entity"], "times").groupBy("row_key").agg(F.collect_list("entity").alias("entities"))
    words = holders.select("row_key", "terms").join(several, "row_key").withColumn("entity", F.explode("entities"))
    together = words.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("both")).filter(F.col("both") >= MIN_DOCS)
    together = common.keep(together)
    # the terms are counted before the join: a semi-join would be moved below the count
    spread = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("docs"))
    # several terms an entity: not one row a key, but their number is that of distinct words beside it
    scored = together.join(times, "entity").join(spread, "term").join(F.broadcast(total))  # one row
    n = F.col("docs").cast("double")
    information = F.log2(n / F.col("times"))
    mutual = F.log2(F.col("both") * n / (F.col("df") * F.col("times")))
    out = common.keep(scored.filter((information > 0) & (mutual >= ALPHA * information)).select("entity", "term", "both"))
    common.discard(times, together)
    return out


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Columns of ``docs`` (with ``text``) and ``base`` and ``spans``, arrays of spans, which replace
    input columns of these names."""
    names = [c for c in docs.columns if c not in ("base", "spans")]
    found = _found(docs.select(F.struct(*names).alias("doc"), common.texts().alias("text")))
    return found.select("doc.*", "base", "spans")


def _found(docs: DataFrame) -> DataFrame:
    """``doc, text, base, spans`` of ``doc, text``.  Only documents with base spans are kept as a step;
    the others' are looked for again, which costs less than their texts on disk."""
    text = F.col("text")
    based = docs.withColumn("base", base_spans(text))
    some_base = common.keep(based.filter(F.size("base") > 0).withColumn("row_key", F.monotonically_increasing_id()))
    words = terms(outside(text, F.col("base")))
    own = F.array_distinct(F.transform("base", entity))
    holders = common.keep(some_base.select("row_key", words.alias("terms"), own.alias("entities")))
    pairs = disclosing(holders, based.select(words.alias("terms")))
    telling = pairs.groupBy("entity").agg(F.max("both").alias("times"))
    some = join_hot(holders.select("row_key", F.explode("entities").alias("entity"), "terms"), telling, ["entity"], "times")
    each = some.select("row_key", "entity", F.explode("terms").alias("term"))
    revealing = join_hot(each, pairs, ["entity", "term"], "both").groupBy("row_key").agg(F.sort_array(F.collect_set("term")).alias("revealing"))
    held = some_base.join(revealing, "row_key", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("revealing", "|"), F.lit(r")(?!\p{L})"))
    more = F.when(F.col("revealing").isNotNull(), matches(text, pattern, len(KINDS), "term")).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))
    inside = F.filter(more, lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    held = held.withColumn("spans", F.array_sort(F.concat("base", inside))).select("doc", "text", "base", "spans")
    clean = based.filter(F.size("base") == 0).select("doc", "text", "base", F.col("base").alias("spans"))
    return clean.unionByName(held)


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each base span generalised to its kind and each revealing term removed; a span
    within those before it leaves no mark of its own."""
    def mark(s: Column, p: Column) -> Column:
        kind = F.when(s["kind"] == "term", F.lit("[REMOVED]")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.when(s["end"] <= p, F.lit("")).otherwise(kind)

    return F.array_join(F.zip_with(gaps(text, spans), F.zip_with(spans, past(spans), mark), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` sanitised; null texts stay null."""
    found = _found(docs.select(F.struct(*docs.columns).alias("doc"), common.texts().alias("text")))
    new = F.when(F.size("spans") > 0, sanitised(F.col("text"), F.col("spans"))).otherwise(F.col("doc.text"))
    return found.select(*(new.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def _places(matches: str, gaps: str) -> str:
    """SQL for the start of match ``i`` from the matches and what lies between them."""
    return f"CAST(list_sum(list_transform({gaps}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({matches}[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"


_SQL_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents), "
    "raw AS ("
    + " UNION ALL ".join(f"SELECT r, {i} AS rank, '{k}' AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d" for i, (k, p) in enumerate(_SQL_PATTERNS.items()))
    + "), "
    "each AS (SELECT r, rank, kind, m, g, unnest(range(1, len(m) + 1)) AS i FROM raw), "
    f"found AS (SELECT r, rank, kind, m[i] AS v, {_places('m', 'g')} AS s, regexp_replace(m[i], '[^0-9]', '', 'g') AS n FROM each), "
    "b AS (SELECT r, rank, kind, v, s, s + length(v) AS e, kind || ':' || CASE kind WHEN 'email' THEN lower(v) WHEN 'ip' THEN v ELSE n END AS entity FROM found WHERE CASE kind WHEN 'email' THEN true "
    "WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) <= 255)) "
    "WHEN 'card' THEN length(n) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(substring(reverse(n), j, 1) AS INTEGER) ELSE (2 * CAST(substring(reverse(n), j, 1) AS INTEGER)) % 10 + (2 * CAST(substring(reverse(n), j, 1) AS INTEGER)) // 10 END)) % 10 = 0 "
    "ELSE length(n) BETWEEN 9 AND 15 END), "
    "p AS (SELECT r, s, rank, e, coalesce(max(e) OVER (PARTITION BY r ORDER BY s, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM b), "
    "gap AS (SELECT d.r, p.s, p.rank, substring(t, p.past + 1, greatest(p.s - p.past, 0)) AS x FROM p JOIN d ON d.r = p.r UNION ALL SELECT d.r, length(t) + 1, 9, substring(t, q.e + 1, length(t)) FROM d JOIN (SELECT r, max(e) AS e FROM b GROUP BY r) q ON q.r = d.r), "
    "rest AS (SELECT r, string_agg(x, ' ' ORDER BY s, rank) AS o FROM gap GROUP BY r UNION ALL SELECT r, t FROM d WHERE r NOT IN (SELECT r FROM b)), "
    "w AS (SELECT r, unnest(list_distinct(regexp_extract_all(lower(o), '\\p{L}+'))) AS term FROM rest), "
    "held AS (SELECT DISTINCT r, entity FROM b), "
    "df AS (SELECT term, count(*) AS df FROM w GROUP BY term), "
    "times AS (SELECT entity, count(*) AS times FROM held GROUP BY entity), "
    "both_ AS (SELECT entity, term, count(*) AS together FROM held JOIN w ON w.r = held.r GROUP BY 1, 2), "
    "n AS (SELECT count(*)::DOUBLE AS n FROM d), "
    f"pairs AS (SELECT entity, term FROM both_ JOIN times USING (entity) JOIN df USING (term), n WHERE times >= {MIN_DOCS} AND together >= {MIN_DOCS} AND log2(n / times) > 0 AND log2(together * n / (df * times)) >= {ALPHA} * log2(n / times)), "
    "bad AS (SELECT DISTINCT held.r, pairs.term FROM held JOIN pairs ON pairs.entity = held.entity JOIN w ON w.r = held.r AND w.term = pairs.term), "
    "tok AS (SELECT r, regexp_extract_all(t, '\\p{L}+') AS m, string_split_regex(t, '\\p{L}+') AS g FROM d WHERE r IN (SELECT r FROM bad)), "
    "tk AS (SELECT r, m, g, unnest(range(1, len(m) + 1)) AS i FROM tok), "
    f"hit AS (SELECT tk.r, {_places('m', 'g')} AS s, length(m[i]) AS k FROM tk JOIN bad ON bad.r = tk.r AND bad.term = lower(m[i])), "
    "term AS (SELECT r, 4 AS rank, 'term' AS kind, s, s + k AS e FROM hit WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = hit.r AND hit.s < b.e AND b.s < hit.s + hit.k)), "
    "every AS (SELECT r, rank, kind, s, e FROM b UNION ALL SELECT r, rank, kind, s, e FROM term), "
    "shown AS (SELECT r, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS) + ", "
    "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans FROM every GROUP BY r) "
    "SELECT doc_id, " + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS) + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN shown ON shown.r = d.r"
)
