"""Chat formatting after a cumulative-snapshot collapse.

Logs often hold a conversation again and again as it grows. A turn's prefix hash stands for all turns up to it; a
conversation whose last prefix hash is an earlier prefix hash of another one is a prefix of a longer one. Anti-joins keep
the maximal conversations, of equal ones the one with the smallest id, and these are rendered turn by turn.

The prefix hash is the exclusive-or of two 64-bit hashes of (position, role, text) each, so it can be summed in pieces:
a conversation is dealt out in stretches of ``stretch`` turns, and no task needs a whole one. All joins are on distinct
hashes or on a conversation's id against one row per conversation. The turns with their hashes are saved once and read
for the hashes alone until the kept ones are rendered.

Defined results: turns are ordered by turn (null first), then role, then text, and count by position, so ties and gaps
are no matter; repeated rows are turns of their own; a null conv_id is one conversation; null role or text differ from
empty ones and render as empty; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import saved

STRETCH = 256
#: The turn markers of the rendered form.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: A conversation and one stretch of it, each a value and whether it is null, so that plain equality and one shuffle serve all steps.
CONV = ("conv", "no_conv")
PIECE = (*CONV, "stretch", "no_stretch")


def _key(name: str, value: Column) -> tuple[Column, Column]:
    return F.coalesce(value, F.lit(0).cast("long")).alias(name), value.isNull().alias(f"no_{name}")


def positioned(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """conv, no_conv, turn, role, text, position from 1, and the prefix hashes p1 and p2 up to each turn and b1 and b2 before it.

    Texts are shuffled once, by stretch; windows and joins of a stretch's turns keep that partitioning.
    """
    base = turns.select(
        *_key("conv", F.col("conv_id").cast("long")),
        *_key("stretch", F.floor(F.col("turn") / stretch).cast("long")),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    placed = base.withColumn("at", F.row_number().over(Window.partitionBy(*PIECE).orderBy("turn", "role", "text")))
    counts = base.groupBy(*PIECE).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*CONV).orderBy(F.col("no_stretch").desc(), "stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*PIECE, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    numbered = placed.join(starts, [*PIECE]).withColumn("position", F.col("start") + F.col("at"))

    content = (F.col("position"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    hashed = numbered.withColumns({"t1": F.xxhash64(F.lit(1), *content), "t2": F.xxhash64(F.lit(2), *content)})
    running = Window.partitionBy(*PIECE).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = hashed.withColumns({"l1": F.bit_xor("t1").over(running), "l2": F.bit_xor("t2").over(running)})
    sums = hashed.groupBy(*PIECE).agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    offsets = sums.select(*PIECE, F.coalesce(F.bit_xor("x1").over(earlier), F.lit(0)).alias("o1"), F.coalesce(F.bit_xor("x2").over(earlier), F.lit(0)).alias("o2"))
    p1, p2 = F.col("l1").bitwiseXOR(F.col("o1")), F.col("l2").bitwiseXOR(F.col("o2"))
    return local.join(offsets, [*PIECE]).select(
        *CONV, "turn", "role", "text", "position", p1.alias("p1"), p2.alias("p2"),
        p1.bitwiseXOR(F.col("t1")).alias("b1"), p2.bitwiseXOR(F.col("t2")).alias("b2"), "t1", "t2",
    )


def maximal(turns: DataFrame) -> DataFrame:
    """conv, no_conv, n_turns and n_copies of each conversation that is no prefix of a longer one and no copy of an earlier one."""
    ends = turns.groupBy(*CONV).agg(F.count("*").alias("n"), F.bit_xor("t1").alias("h1"), F.bit_xor("t2").alias("h2"))
    distinct = ends.groupBy("h1", "h2", "n").agg(F.min(F.struct("no_conv", "conv")).alias("c"), F.count("*").alias("n_copies"))
    inner = turns.where("position > 1").select(F.col("b1").alias("h1"), F.col("b2").alias("h2"), (F.col("position") - 1).alias("n")).distinct()
    return distinct.join(inner, ["h1", "h2", "n"], "left_anti").select("c.conv", "c.no_conv", F.col("n").alias("n_turns"), "n_copies")


def chat_format(conversations: DataFrame) -> DataFrame:
    """One row per turn of each maximal conversation: conv_id, turn, position, n_turns, n_copies, rendered.

    The rendered turns of a conversation, joined in the order of their positions, are its text.
    """
    turns = saved(positioned(conversations), "chat-turns")
    rendered = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(f"{CLOSE}\n"))
    conv = F.when(~F.col("no_conv"), F.col("conv"))
    return turns.join(maximal(turns), [*CONV]).select(conv.alias("conv_id"), "turn", "position", "n_turns", "n_copies", rendered.alias("rendered"))


def op10_chat_format(conversations: DataFrame) -> DataFrame:
    return chat_format(conversations)


ORACLE_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position FROM conversations
), p AS (
  SELECT *, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY position) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM t
), ends AS (
  SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE position = n GROUP BY prefix
), kept AS (
  SELECT * FROM ends WHERE prefix NOT IN (SELECT prefix FROM p WHERE position < n)
)
SELECT t.conv_id, t.turn, t.position, len(k.prefix)::BIGINT AS n_turns, k.n_copies,
  '{OPEN}' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '{CLOSE}' || chr(10) AS rendered
FROM t JOIN kept k ON t.conv_id IS NOT DISTINCT FROM k.conv_id
"""
