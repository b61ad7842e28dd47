"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered once more with that speaker as the assistant. All other
speakers are users, named in their header. Only the assistant's words and their end mark count for the loss.

A conversation may hold any share of the rows, so no dialogue is gathered into one value: a rendering is its rows in
order, one for each turn, each with the rendered segment, where it starts and ends in the whole rendering, and its mask.
Starts come from sums over blocks of BLOCK turns and sums over those of BLOCK blocks, so that no ordered pass over a
conversation is longer than its turns divided by BLOCK.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

#: Turns of a block.
BLOCK = 256
#: Fixed marks of the rendering.
OPEN, CLOSE, NAME = "<|im_start|>", "<|im_end|>\n", " name="
#: Characters that would forge a mark inside a text or name, and what stands in their place.
FORGED, PLAIN = "<|", "<​|"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit(FORGED), F.lit(PLAIN))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per (conversation, participant, row of the conversation).

    Columns: conv_id, perspective, turn, part (position in the rendering, from 0), speaker, chat_role (`assistant` or
    `user`), rendered, start, end (code points in the whole rendering, end exclusive), mask_start, mask_end (the span that
    counts for the loss; equal where nothing does). A null role is the participant `unknown`; null text is empty. Rows follow
    turn, nulls first, then speaker, then text; repeated rows stay repeated. Texts and names cannot forge a mark: `<|` in them is
    broken up by a zero-width space, the one change to a text. Every role is a participant, `system` too. A conversation with one
    participant has one rendering; an empty table has none. Null conversation ids are one conversation. Other columns take no
    part. The output has turns times participants rows a conversation, as the rotation asks for: where everyone speaks once, that
    is the square of its turns.
    """
    # __key: the conversation id in a struct, as structs around null are equal. Joins on it keep rows dealt as windows by it want them.
    said = turns.select(
        F.struct(F.col(conv).alias("conv_id")).alias("__key"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("speaker"), text_or_empty(F.col(text)).alias("words"),
    )
    as_self = F.concat(F.lit(OPEN + "assistant\n"), _safe(F.col("words")), F.lit(CLOSE))
    as_other = F.concat(F.lit(OPEN + "user" + NAME), _safe(F.col("speaker")), F.lit("\n"), _safe(F.col("words")), F.lit(CLOSE))
    said = said.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    said = said.withColumn("own", F.length(as_self).cast("long")).withColumn("other", F.length(as_other).cast("long"))
    # Sums of each block, by speaker; texts take no part in them. A rendering's length is that of all rows as users, less
    # what the assistant's own rows save.
    sums = said.groupBy("__key", "block", "speaker").agg(
        F.count("*").alias("n"), F.sum("other").alias("size"), F.sum(F.col("other") - F.col("own")).alias("saved")
    )
    people = sums.select("__key", F.col("speaker").alias("perspective")).distinct()
    blocks = sums.groupBy("__key", "block").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    before = Window.partitionBy("__key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "__key", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size_before")
    )
    grid = blocks.join(people, "__key")
    own = sums.select("__key", "block", F.col("speaker").alias("perspective"), "saved")
    grid = grid.join(own, ["__key", "block", "perspective"], "left")
    earlier = Window.partitionBy("__key", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("block_saved", F.coalesce(F.sum("saved").over(earlier), F.lit(0))).drop("saved")
    # Order in the block, then one row for each participant. All of it is dealt by (conversation, block).
    in_block = Window.partitionBy("__key", "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "words")
    said = said.withColumn("place", F.row_number().over(in_block) - 1)
    said = said.withColumn("other_before", F.sum("other").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("other"))
    seen = said.join(grid, ["__key", "block"])
    is_self = F.col("speaker") == F.col("perspective")
    gain = F.when(is_self, F.col("other") - F.col("own")).otherwise(0)
    ahead = Window.partitionBy("__key", "block", "perspective").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("start", F.col("size_before") + F.col("other_before") - F.col("block_saved") - F.coalesce(F.sum(gain).over(ahead), F.lit(0)))
    end = F.col("start") + F.when(is_self, F.col("own")).otherwise(F.col("other"))
    return seen.select(
        F.col("__key.conv_id").alias("conv_id"), "perspective", "turn", (F.col("rows_before") + F.col("place")).alias("part"), "speaker",
        F.when(is_self, "assistant").otherwise("user").alias("chat_role"), F.when(is_self, as_self).otherwise(as_other).alias("rendered"),
        "start", end.alias("end"), F.when(is_self, F.col("start") + len(OPEN + "assistant\n")).otherwise(end).alias("mask_start"), end.alias("mask_end"),
    )


def chat_format(conversations: DataFrame) -> DataFrame:
    """rotate() over the table of conversations."""
    return rotate(conversations.select("conv_id", "turn", "role", "text"))


CHAT_SQL = f"""
WITH t AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '{FORGED}', '{PLAIN}') AS words FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t),
r AS (SELECT t.*, p.perspective, t.speaker = p.perspective AS own,
    CASE WHEN t.speaker = p.perspective THEN '{OPEN}assistant' ELSE '{OPEN}user{NAME}' || replace(t.speaker, '{FORGED}', '{PLAIN}') END || chr(10) || words || '<|im_end|>' || chr(10) AS rendered
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, row_number() OVER w - 1 AS part, sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fin
  FROM r WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, words))
SELECT conv_id, perspective, turn, part::BIGINT AS part, speaker, CASE WHEN own THEN 'assistant' ELSE 'user' END AS chat_role, rendered,
  (fin - length(rendered))::BIGINT AS start, fin::BIGINT AS "end",
  CASE WHEN own THEN fin - length(rendered) + {len(OPEN + "assistant") + 1} ELSE fin END::BIGINT AS mask_start, fin::BIGINT AS mask_end
FROM o
"""
