"""Perspective rotation of dialogues: each participant in turn is the assistant.

For every participant of a conversation each turn is rendered once: the
participant's own turns as ``assistant`` with a loss mask over what was said, all
others as ``user`` with their name; system turns stay system turns.  One row per
(conversation, perspective, turn), so a conversation of any length stays spread
over tasks; participants are counted first and joined to the turns.

Edge cases: a null or empty role is nobody: such turns are nameless users in
every perspective and make no perspective; null texts are empty; null
conversation ids are one conversation; null turns and repeated rows are rendered
each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def participants(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective): who speaks in each conversation, system aside."""
    spoken = turns.where(F.col("role").isNotNull() & (F.col("role") != "") & (F.col("role") != SYSTEM))
    return spoken.select("conv_id", F.col("role").alias("perspective")).distinct()


def rotated(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, chat_role, name, rendered, mask_start, mask_end, trained).

    The mask is the half-open range of characters of `rendered` that carry loss; it is empty where
    nothing is trained.
    """
    t = turns.select("conv_id", "turn", "role", F.coalesce(F.col("text"), F.lit("")).alias("content")).alias("t")
    who = participants(turns).alias("w")
    both = t.join(who, F.col("t.conv_id").eqNullSafe(F.col("w.conv_id"))).select("t.*", "perspective")
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    chat_role = F.when(own, "assistant").when(F.col("role") == SYSTEM, SYSTEM).otherwise("user")
    name = F.when((F.col("chat_role") == "user") & (F.col("role") != ""), F.col("role"))
    head = F.concat(F.lit(OPEN), F.col("chat_role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    begin = F.char_length(head)
    return both.withColumn("chat_role", chat_role).withColumn("name", name).select(
        "conv_id", "perspective", "turn", "chat_role", "name",
        F.concat(head, F.col("content"), F.lit(CLOSE)).alias("rendered"),
        masked(own, begin).alias("mask_start"),
        masked(own, begin + F.char_length("content") + len(CLOSE) - 1).alias("mask_end"),
        own.alias("trained"),
    )


def masked(own: Column, at: Column) -> Column:
    """Loss lies on the speaker's words and the closing mark, from which the model learns to stop."""
    return F.when(own, at).otherwise(0).cast("long")


def dialogues(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, masks): each whole dialogue with the character ranges that carry loss.

    One dialogue is one value, so this is for conversations that fit a task; turns go by (turn, rendered).
    """
    rows = rotated(turns).groupBy("conv_id", "perspective").agg(
        F.sort_array(F.collect_list(F.struct("turn", "rendered", "mask_start", "mask_end", "trained"))).alias("turns"))
    sizes = F.transform("turns", lambda x: F.char_length(x["rendered"]).cast("long"))
    start = lambda i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b)
    placed = F.transform("turns", lambda x, i: F.struct(
        (start(i) + x["mask_start"]).alias("from"), (start(i) + x["mask_end"]).alias("to"), x["trained"].alias("trained")))
    kept = F.transform(F.filter(placed, lambda x: x["trained"]), lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to")))
    return rows.withColumn("sizes", sizes).select(
        "conv_id", "perspective", F.array_join(F.transform("turns", lambda x: x["rendered"]), "").alias("text"), kept.alias("masks")
    )


ROTATED_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS content FROM conversations),
w AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role IS NOT NULL AND role <> '' AND role <> 'system'),
b AS (SELECT t.*, perspective, coalesce(role = perspective, false) AS trained,
        CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' END AS chat_role
      FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
n AS (SELECT *, CASE WHEN chat_role = 'user' AND role <> '' THEN role END AS name FROM b),
h AS (SELECT *, '<|im_start|>' || chat_role || coalesce(' name=' || name, '') || chr(10) AS head FROM n)
SELECT conv_id, perspective, turn, chat_role, name, head || content || '<|im_end|>' || chr(10) AS rendered,
  CAST(CASE WHEN trained THEN length(head) ELSE 0 END AS BIGINT) AS mask_start,
  CAST(CASE WHEN trained THEN length(head) + length(content) + 10 ELSE 0 END AS BIGINT) AS mask_end, trained
FROM h"""
