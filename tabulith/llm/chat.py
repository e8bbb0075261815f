"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as named users; system turns belong to nobody. Each turn is one segment
with its place in the rendered text and, where the speaker is the assistant, the span of its
content, which is what a loss mask covers. Segments of a perspective joined by position are the
rendered dialogue.

Only DataFrame operations are used. Turns are sorted over all tasks and cut where a task's share
ends, so a conversation of any length, even one whose turns have all the same number, lies in
pieces of at most such a share. Participants are joined with pieces, and places are prefix sums in
two levels, inside pieces and over them.

Defined results: a null role is the speaker "unknown", and one participant with a speaker of that
name; null text is empty; turns are ordered by turn, role and text with nulls first, and ties of all
three are equal turns, whose order makes no difference; texts that agree in their first 64
characters are ordered by their hash; repeated rows stay and follow each other; a
null conv_id is a conversation of its own; a conversation of system turns alone has no perspective;
texts of any length are rendered whole; marks of the format inside a text are left as they are, since
places tell where each segment lies; an empty table gives an empty result; other columns are never
read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulith.llm.common import shuffle_width, staged

# The marks of the rendered format.
OPEN, NAME, BREAK, CLOSE = "<|start|>", " name=", "\n", "<|end|>\n"
SYSTEM = "system"


def rotate(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """One row per conversation, perspective and turn."""
    turns = conversations.select(
        # As a key of its own a null conv_id meets itself.
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("none")).alias("k"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # What sorts is short, since samples of it come to the driver; chance cuts between equal turns.
    turns = turns.withColumn("t64", F.substring("text", 1, 64)).withColumn("th", F.xxhash64("text"))
    turns = turns.repartitionByRange(shuffle_width(spark), "k", "turn", "speaker", "t64", "th", F.rand(7))
    turns = staged(spark, turns.withColumn("b", F.spark_partition_id()), "turns")
    people = turns.where(F.col("speaker") != SYSTEM).select("k", F.col("speaker").alias("perspective")).distinct()
    pieces = turns.select("k", "b").distinct()
    seen = turns.join(pieces.join(people, "k"), ["k", "b"])
    mine = F.col("speaker") == F.col("perspective")
    head = F.when(F.col("speaker") == SYSTEM, F.lit(OPEN + SYSTEM + BREAK)).when(mine, F.lit(OPEN + "assistant" + BREAK)).otherwise(F.concat(F.lit(OPEN + "user" + NAME), "speaker", F.lit(BREAK)))
    seen = seen.select(
        "k", "conv_id", "perspective", "turn", "speaker", "text", mine.alias("masked"), head.alias("head"), F.concat(head, "text", F.lit(CLOSE)).alias("segment"), "b", "t64", "th"
    )
    seen = seen.withColumn("size", F.length("segment").cast("long"))
    inside = Window.partitionBy("k", "perspective", "b").orderBy("turn", "speaker", "t64", "th", "text").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("k", "perspective").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = seen.groupBy("k", "perspective", "b").agg(F.sum("size").alias("whole"))
    blocks = blocks.select("k", "perspective", "b", F.coalesce(F.sum("whole").over(over), F.lit(0)).alias("base"))
    placed = seen.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(blocks, ["k", "perspective", "b"])
    start = F.col("base") + F.col("before")
    text_start = start + F.length("head")
    return placed.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).when(F.col("masked"), F.lit("assistant")).otherwise(F.lit("user")).alias("rendered_role"),
        "segment",
        start.alias("char_start"),
        (start + F.col("size")).alias("char_end"),
        F.when(F.col("masked"), text_start).alias("mask_start"),
        F.when(F.col("masked"), text_start + F.length("text")).alias("mask_end"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), s AS (
  SELECT t.conv_id, perspective, turn, speaker, text,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS rendered_role,
    CASE WHEN speaker = 'system' THEN '<|start|>system' WHEN speaker = perspective THEN '<|start|>assistant'
         ELSE '<|start|>user name=' || speaker END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), g AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM s
), o AS (
  SELECT *, CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM g
)
SELECT conv_id, perspective, turn, speaker, rendered_role, segment, char_start, char_start + length(segment) AS char_end,
  CASE WHEN speaker = perspective THEN char_start + length(head) END AS mask_start,
  CASE WHEN speaker = perspective THEN char_start + length(head) + length(text) END AS mask_end
FROM o
"""
