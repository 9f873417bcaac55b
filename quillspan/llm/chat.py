"""Logged conversations: those that are the beginning of longer ones are dropped, the rest is rendered; DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.scratch import cut

#: Turns of one block of numbers are handled together; longer conversations are summed and rendered by blocks.
BLOCK = 64


def _leaf(turns: DataFrame) -> DataFrame:
    said = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return turns.withColumn("block", F.floor(F.col("turn") / BLOCK)).withColumn("g1", F.xxhash64(*said)).withColumn("g2", F.xxhash64(F.lit(7), *said))


def _before(rows: DataFrame, *sums: Column) -> DataFrame:
    """For each block of a conversation, sums over the blocks before it, and the conversation's turns."""
    per = Window.partitionBy("conv_id")
    earlier = per.orderBy(F.col("block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"), *[s.alias(f"s{i}") for i, s in enumerate(sums)])
    return out.select("conv_id", F.coalesce("block", F.lit(-1 << 62)).alias("at"), F.sum("n").over(per).alias("n_turns"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("b"), *[F.coalesce(F.sum(f"s{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in range(len(sums))])


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, idx (from 1), n_turns and two sums h1 and h2 that stand for the conversation up to that turn.

    Each turn adds numbers of 40 bits made from its place, role and text, so that sums roll on from turn to turn, within
    a block and over blocks, and no task needs a whole conversation.
    """
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "g1", "g2")
    leaf = cut(_leaf(turns).select("conv_id", "turn", "block", "g1", "g2"), "turns")
    at = F.coalesce(leaf["block"], F.lit(-1 << 62)).alias("at")
    placed = leaf.select("*", at).withColumn("row", F.row_number().over(order)).join(_before(leaf), ["conv_id", "at"]).withColumn("idx", F.col("b") + F.col("row"))
    placed = placed.withColumn("f1", F.xxhash64("idx", "g1", "g2").bitwiseAND(F.lit((1 << 40) - 1))).withColumn("f2", F.shiftrightunsigned(F.xxhash64("g2", "idx", "g1"), 24))
    placed = cut(placed.select("conv_id", "turn", "block", "at", "g1", "g2", "idx", "n_turns", "f1", "f2"), "placed")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("r1", F.sum("f1").over(run)).withColumn("r2", F.sum("f2").over(run))
    offsets = _before(placed, F.sum("f1"), F.sum("f2")).select("conv_id", "at", "b0", "b1")
    return summed.join(offsets, ["conv_id", "at"]).select("conv_id", "idx", "n_turns", (F.col("r1") + F.col("b0")).alias("h1"), (F.col("r2") + F.col("b1")).alias("h2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that begin no longer one; of equal ones the smallest id."""
    prefixes = cut(prefix_hashes(turns), "prefixes")
    whole = prefixes.where("idx = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    begun = prefixes.where("idx < n_turns").groupBy(F.col("idx").alias("n_turns"), "h1", "h2").agg(F.count("*").alias("n")).drop("n")
    return whole.join(begun, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def format_chats(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Renders the conversations that no longer one continues.

    One row for each block of 64 turn numbers of such a conversation: conv_id, segment (that block's number, 0 unless it
    is longer), n_turns (of the whole), n_copies (conversations equal to it, itself included) and rendered. A turn reads
    <|im_start|>role, a line feed, its text, <|im_end|> and a line feed; "<|" within a role or text becomes "< |".

    A conversation's turns are ordered by number, null last; turns with one number by a hash of role and text, and equal
    rows count as often as they occur. Conversations are equal, or one begins the other, if their turns' roles and texts
    in that order do, whatever the numbers. A null role or text is not the same as an empty one and is rendered as
    unknown and as nothing. Rows without conv_id belong to no conversation and are left out; those without turn form a
    segment of their own, null. A task holds one segment, so that turns of one number, or without any, must fit there. An
    empty table gives an empty table. Other columns are not read.
    """
    turns = conversations.select(F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).where("conv_id is not null")
    kept = cut(maximal_conversations(turns), "maximal")
    safe = lambda c, none: F.replace(F.coalesce(c, F.lit(none)), F.lit("<|"), F.lit("< |"))
    piece = F.concat(F.lit("<|im_start|>"), safe(F.col("role"), "unknown"), F.lit("\n"), safe(F.col("text"), ""), F.lit("<|im_end|>\n"))
    pieces = _leaf(turns).select("conv_id", F.col("block").alias("segment"), F.struct("turn", "g1", "g2", piece.alias("piece")).alias("p")).join(kept, "conv_id")
    return pieces.groupBy("conv_id", "segment", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("p")).alias("ps")).select("conv_id", "segment", "n_turns", "n_copies", F.array_join(F.col("ps.piece"), "").alias("rendered"))


#: The same for conversations of up to 64 turns, numbered without ties, by comparing whole strings.
CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered
  FROM conversations GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, rendered FROM c GROUP BY n_turns, rendered)
SELECT conv_id, CAST(0 AS BIGINT) AS segment, n_turns, n_copies, rendered FROM u a
WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.n_turns > a.n_turns AND starts_with(b.rendered, a.rendered))"""
