"""Operator 3: reply trees as conversations.

Messages form trees by ``parent``.  Two tables are joined with themselves, doubling the distance in
each round, so a path of ``n`` messages takes about ``log2(n)`` rounds: a jump table (each message's
ancestor ``2^k`` above) and the paths from the leaves (leaf, ancestor, distance).  Paths that reach
a root are ranked by score within their tree and the best ``per_tree`` are formatted.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Inside texts and roles each
``<``, backslashes, ``|`` gets one backslash more, so no control string can appear, and one is taken
away in reading; a role's line breaks are written ``\\n`` (and its backslashes doubled).  The loss
mask covers the texts of the assistant's turns.

Null text or role: empty.  Null tree or message keys, and messages that hang in a cycle or under a
missing parent without reaching a root, are on no path and take no part.  Rows that repeat a message's
key are turns of every path through it, by role and text, and hang on the least of their parents.

For ``conversations``: rows with a null ``conv_id`` are one conversation, whose id stays null; a table
that holds -1 itself keeps that conversation beside the added one.  Repeated rows stay, in the order
turn (null first), role, text.  Very long texts are kept whole; the turns of one conversation are
gathered in one task, which has to hold a conversation in any case to format it.  An empty table
gives the added conversation only, an empty table of messages no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm import common

START, STOP = "<|im_start|>", "<|im_end|>"
_OPEN, _OPENED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
CONTROL = "<|im_end|><|im_start|>assistant ok"


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the spans of its loss mask (code points)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role_out(role or '')}\n", escape(text or "")
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, STOP, "\n"]
        at += len(head) + len(body) + len(STOP) + 1
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((_role_in(role), unescape(rest[: -len(STOP) - 1])))
    return turns


def root_to_leaf_paths(nodes: DataFrame) -> DataFrame:
    """``tree, leaf, node, up`` for each node of each path from a root to a leaf, by self-joins.

    ``nodes``: ``tree, node, parent`` (parent null: a root).
    """
    nodes = common.keep(nodes.filter(F.col("tree").isNotNull() & F.col("node").isNotNull()).groupBy("tree", "node").agg(F.min("parent").alias("parent")))
    parents = nodes.select("tree", F.col("parent").alias("node")).filter(F.col("node").isNotNull()).distinct()
    paths = common.keep(nodes.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    jumps = nodes.filter(F.col("parent").isNotNull()).select("tree", "node", F.col("parent").alias("to"))
    most, far = nodes.count(), 1
    while far <= most:
        step = jumps.withColumnRenamed("tree", "t").withColumnRenamed("node", "n")
        # the upper end of each path so far lies ``far - 1`` above its leaf or is a root
        more = paths.join(step, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + far).alias("up"))
        longer = common.keep(more)
        if longer.isEmpty():
            break
        paths = common.keep(paths.unionByName(longer))
        jumps = common.keep(jumps.join(jumps.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("to").alias("next")), (F.col("tree") == F.col("t")) & (F.col("to") == F.col("n"))).select("tree", "node", F.col("next").alias("to")))
        far *= 2
    roots = nodes.filter(F.col("parent").isNull()).select("tree", "node")
    whole = paths.join(roots, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
    return paths.join(whole, ["tree", "leaf"], "left_semi")


def best_conversations(messages: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """``tree, leaf, rank, score, turns`` of each tree's best paths.

    ``messages``: ``tree, node, parent, role, text, score``; a path's score is the sum of its
    messages' scores (null: 0), ties go to the smaller leaf.  ``per_tree`` None: every path.
    """
    paths = root_to_leaf_paths(messages)
    full = paths.join(messages.select("tree", "node", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score")), ["tree", "node"])
    ranked = full.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    return ranked.filter(F.col("rank") <= per_tree) if per_tree else ranked


def format_conversations(chosen: DataFrame) -> DataFrame:
    """``tree, rank, formatted, loss_spans`` of ``tree, rank, turns``."""
    kind = chosen.schema["tree"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, spans = [], []
            for turns in batch.column(2).to_pylist():
                text, span = format_turns([(t["role"], t["text"]) for t in turns])
                texts.append(text)
                spans.append([{"start": a, "stop": b} for a, b in span])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["tree", "rank", "formatted", "loss_spans"])

    return chosen.select("tree", "rank", "turns").mapInArrow(run, f"tree {kind}, rank int, formatted string, loss_spans array<struct<start:long,stop:long>>")


def conversation_messages(conversations: DataFrame, prefix: str = "") -> DataFrame:
    """Rows by turn as a chain of messages: each answers the one before it.  ``tree`` is the
    conversation's id as text behind ``prefix``; a null id has no text behind it."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    tree = F.concat(F.lit(f"{prefix}:"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    rows = conversations.select(tree.alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), common.texts().alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse_turns(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            ids = [int(t.partition(":")[2]) if t[-1] != ":" else None for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(run, DIGEST)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    messages = common.keep(conversation_messages(rows).unionByName(conversation_messages(extra, "added")))
    return conversation_digest(format_conversations(best_conversations(messages)))


SQL = """
WITH c AS (
  SELECT 0 AS own, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT 1, -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT 1, -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(role, '\\', '\\\\'), chr(10), '\\n') AS shown FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(shown) + len(regexp_extract_all(shown, '<\\\\*\\|')) + length(text) + len(regexp_extract_all(text, '<\\\\*\\|'))) AS BIGINT) AS formatted_chars
FROM e GROUP BY own, conv_id
"""
