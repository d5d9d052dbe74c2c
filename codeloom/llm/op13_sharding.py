"""Operator 13: sharding by jump consistent hashing, in DataFrame functions only.

A key's buckets form a chain: from bucket b the next one that it would jump to, were there enough
shards, is ``floor((b + 1) * 2^31 / ((state >> 33) + 1))`` with the state of a 64-bit linear congruential
generator that starts from the key's hash.  With n shards the key lies in the last bucket of the chain
below n.  No ring table is kept; one more shard takes the rows whose chain goes on to it, and no row
goes anywhere else.  The hash is the first 64 bits of the key's SHA-256, so any engine gives the same
shard.  Products modulo 2^64 are formed of 16-bit parts, since the session may check for overflow.

``assign_shards`` adds columns by a projection, without a shuffle.  ``number_slots`` gives every row of
a shard a place, gapless from 0.  It counts equal rows first, takes them in pieces of ``PIECE``, deals
the pieces to ``BUCKETS`` parts of each shard by a hash of the whole row, numbers them part by part, and
adds what the parts before hold; so neither a hot key nor a group of equal texts or rows gathers in a
task, and only the parts' sizes (shards x ``BUCKETS`` rows at most) are broadcast.

Null keys share one shard, that of the empty key.  Null texts count as empty.  Repeated rows get a slot
each, in one shard.  An empty table: no rows.  ``assign_shards`` keeps other columns and replaces those
named like its own; ``number_slots`` keeps the columns it is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm import common

# Fixed values of jump consistent hashing (Lamping and Veach).
MULTIPLIER, SPAN = 2862933555777941757, 1 << 31
HALF, PART = (1 << 32) - 1, (1 << 16) - 1
BUCKETS, PIECE = 4096, 1 << 16


def _times(x: Column, y: int) -> tuple[Column, Column]:
    """Low and high 32 bits of ``x * y`` for 32-bit ``x`` and ``y``, by the 16-bit parts of ``x``."""
    low, high = x.bitwiseAND(PART) * F.lit(y), F.shiftright(x, 16) * F.lit(y)
    low = low + F.shiftleft(high.bitwiseAND(PART), 16)
    return low.bitwiseAND(HALF), F.shiftright(low, 32) + F.shiftright(high, 16)


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """``state * MULTIPLIER + 1`` modulo 2^64, as high and low 32 bits."""
    m_high, m_low = MULTIPLIER >> 32, MULTIPLIER & HALF
    base, carry = _times(low, m_low)
    up = carry + _times(high, m_low)[0] + _times(low, m_high)[0]
    base = base + F.lit(1)
    return (up + F.shiftright(base, 32)).bitwiseAND(HALF), base.bitwiseAND(HALF)


def key_digest(key: Column) -> Column:
    return F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256)


def _digits(digest: Column, first: int, n: int) -> Column:
    return F.conv(F.substring(digest, first, n), 16, 10).cast("long")


def chain(digest: Column, most: int) -> Column:
    """The buckets below ``most`` that a key with this digest visits, in order, the first of which is 0."""
    start = F.struct(F.array(F.lit(0).cast("long")).alias("seen"), F.lit(0).cast("long").alias("at"), _digits(digest, 1, 8).alias("high"), _digits(digest, 9, 8).alias("low"))

    def step(acc: Column, _: Column) -> Column:
        high, low = _next_state(acc["high"], acc["low"])
        jump = F.floor((acc["at"] + 1) * (F.lit(float(SPAN)) / (F.shiftright(high, 1) + 1).cast("double")))
        seen = F.when(jump < most, F.array_append(acc["seen"], jump)).otherwise(acc["seen"])
        return F.when(acc["at"] < most, F.struct(seen.alias("seen"), jump.alias("at"), high.alias("high"), low.alias("low"))).otherwise(acc)

    # each step goes up by one bucket at least
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda acc: acc["seen"])


def shard_of(visited: Column, shards: int) -> Column:
    """The last bucket of a chain below ``shards``."""
    # never null, which Spark cannot see: it would look for nulls once more at each join
    return F.coalesce(F.array_max(F.filter(visited, lambda b: b < shards)), F.lit(0)).cast("int")


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 24, more: int = 1) -> DataFrame:
    """All columns, with ``shard`` among ``shards`` and ``grown_shard`` among ``shards + more``."""
    out = df.withColumn("chain__", chain(key_digest(F.col(key)), shards + more))
    return out.withColumns({"shard": shard_of(F.col("chain__"), shards), "grown_shard": shard_of(F.col("chain__"), shards + more)}).drop("chain__")


def number_slots(df: DataFrame, spread: Column, shard: str = "shard") -> DataFrame:
    """All columns, with ``slot``: the row's place in its shard.  ``spread`` is a number that deals the
    rows of a shard out; give a narrow table, since rows are told apart by all columns."""
    columns = [c for c in df.columns if c != "slot"]
    counted = df.select(*columns, spread.cast("long").alias("spread__")).groupBy(*columns, "spread__").agg(F.count("*").alias("rows__"))
    pieces = counted.withColumn("piece__", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows__ - 1) div {PIECE}"))))
    pieces = pieces.withColumns({"bucket__": F.coalesce((F.col("spread__") + F.col("piece__")).bitwiseAND(BUCKETS - 1), F.lit(0)), "many__": F.least(F.lit(PIECE), F.col("rows__") - F.col("piece__") * PIECE)})
    parts = pieces.groupBy(shard, "bucket__").agg(F.sum("many__").alias("part__"))
    upto = Window.partitionBy(shard).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(shard, "bucket__", F.coalesce(F.sum("part__").over(upto), F.lit(0)).alias("before__"))
    inside = Window.partitionBy(shard, "bucket__").orderBy(*[F.asc_nulls_first(c) for c in columns], "piece__").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("first__", F.coalesce(F.sum("many__").over(inside), F.lit(0)))
    placed = placed.join(F.broadcast(before), [shard, "bucket__"])  # at most shards x BUCKETS rows
    first = F.col("before__") + F.col("first__")
    return placed.select(*columns, F.explode(F.sequence(first, first + F.col("many__") - 1)).alias("slot"))


def spread_of(key: str, crc: str) -> Column:
    """Twelve bits that differ between texts of one key and between keys of one text."""
    return _digits(key_digest(F.col(key)), 17, 3).bitwiseXOR(F.col(crc).bitwiseAND(BUCKETS - 1))


def op13_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    raw = common.texts().cast("binary")
    narrow = docs.select(F.col("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = number_slots(assign_shards(narrow).withColumn("law", F.lit("key")), spread_of("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


# state and bucket go on from row to row; CRC-32 by bytes, from a table of 256 entries
SQL = f"""
WITH RECURSIVE poly(v, c, k) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT v, CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END, k + 1 FROM poly WHERE k < 8),
crc AS (SELECT list(c ORDER BY v) AS t FROM poly WHERE k = 8),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, sha256(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (
  SELECT doc_id, h, octet_length(raw) + 8 AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(raw), '..'), lambda x: CAST(concat('0x', x) AS BIGINT))), lambda a, x: xor(a // 256, crc.t[(xor(a, x) % 256) + 1])), 4294967295) AS text_crc32
  FROM d, crc),
j(h, b, state) AS (
  SELECT h, CAST(0 AS BIGINT), CAST(concat('0x', h[1:16]) AS UBIGINT)::HUGEINT FROM (SELECT DISTINCT h FROM d)
  UNION ALL
  SELECT h, CAST(floor((b + 1) * (2147483648.0::DOUBLE / ((s // 8589934592) + 1)::DOUBLE)) AS BIGINT), s
  FROM (SELECT h, b, (state * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS s FROM j WHERE b < 25)),
w AS (SELECT h, max(b) FILTER (WHERE b < 24) AS shard, max(b) FILTER (WHERE b < 25) AS grown_shard FROM j GROUP BY h),
p AS (
  SELECT doc_id, size, text_crc32, shard, grown_shard, xor(CAST(concat('0x', k.h[17:19]) AS BIGINT), text_crc32 % {BUCKETS}) AS spread, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // {PIECE} AS piece
  FROM k JOIN w ON k.h = w.h)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY (spread + piece) % {BUCKETS}, doc_id NULLS FIRST, size, text_crc32, piece) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM p
"""
