"""Chat formatting: collapse cumulative snapshots of conversations, then render.

Logs often hold a conversation several times, each snapshot a prefix of the next.
A rolling hash of each conversation's first k turns, for every k, is computed by
windows; a conversation whose own hash is that of the first turns of a longer one is
dropped by an anti-join, and equal conversations stay once. Only the conversations
that stay are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: The markers of the rendered form.
START, END = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Return conv_id, pos (from 1), role, text and k1, k2: the rolling hash of the turns up to pos.

    Turns are ordered by turn, role and text, nulls first. The hash is the exclusive
    or of two 64-bit hashes of (pos, role, text) per turn, so 128 bits in all.
    """
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = rows.withColumn("pos", F.row_number().over(order).cast("long"))
    turn = [F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select("conv_id", "pos", "role", "text", F.bit_xor(F.xxhash64(F.lit("k1"), *turn)).over(upto).alias("k1"), F.bit_xor(F.xxhash64(F.lit("k2"), *turn)).over(upto).alias("k2"))


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn between markers; markers inside role or text are broken by a space."""
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(START), plain(role), F.lit("\n"), plain(text), F.lit(END + "\n"))


def collapse(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, keep_id, kept, rendered (null unless kept).

    ``keep_id`` is the longest conversation that begins with all turns of this one
    (of equally long ones, the smallest id, null last): itself if it is kept. A null
    role or text differs from an empty one and is rendered as empty; rows with a
    null id are one conversation, whose id is null; a repeated row is a repeated
    turn; an empty table gives no rows; other columns are not read.
    """
    placed = materialize(turns(conversations, id_col, turn_col, role_col, text_col), "turns")
    final = placed.groupBy("conv_id").agg(F.max(F.struct("pos", "k1", "k2")).alias("last"))
    final = materialize(final.select("conv_id", F.col("last.pos").alias("pos"), F.col("last.k1").alias("k1"), F.col("last.k2").alias("k2")), "finals")
    # Of each prefix that is some whole conversation: who has it, the longest first.
    longest = F.struct((-F.col("n")).alias("n"), F.col("conv_id").isNull().alias("none"), "conv_id")
    prefixes = placed.select("conv_id", "pos", "k1", "k2").alias("p")
    sized = prefixes.join(final.select(F.col("conv_id").alias("c"), F.col("pos").alias("n")), F.col("p.conv_id").eqNullSafe(F.col("c"))).select("conv_id", "pos", "k1", "k2", "n")
    holders = materialize(sized.groupBy("pos", "k1", "k2").agg(F.min(longest).alias("best")), "holders")
    longer = holders.where(-F.col("best.n") > F.col("pos")).select("pos", "k1", "k2")
    maximal = final.join(longer, ["pos", "k1", "k2"], "left_anti")
    once = maximal.groupBy("pos", "k1", "k2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("first")).select(F.col("first.conv_id").alias("c"))
    said = placed.join(once, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("conv_id", F.struct("pos", rendered_turn(F.col("role"), F.col("text")).alias("turn")).alias("turn"))
    texts = said.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("turn"))["turn"], "").alias("rendered")).withColumnRenamed("conv_id", "r")
    named = final.join(holders, ["pos", "k1", "k2"]).select("conv_id", F.col("pos").alias("n_turns"), F.col("best.conv_id").alias("keep_id"))
    out = named.join(texts, F.col("conv_id").eqNullSafe(F.col("r")), "left")
    return out.select("conv_id", "n_turns", "keep_id", F.col("conv_id").eqNullSafe(F.col("keep_id")).alias("kept"), "rendered")


def op6_chat(spark, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations),
p AS (SELECT conv_id, pos, list(struct_pack(r := role, x := text)) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t),
f AS (
  SELECT conv_id, max(pos) AS n, max_by(prefix, pos) AS prefix FROM p GROUP BY conv_id),
h AS (
  SELECT f.conv_id, f.n, g.conv_id AS holder,
         row_number() OVER (PARTITION BY f.conv_id ORDER BY g.n DESC, g.conv_id) AS place
  FROM f JOIN p ON p.pos = f.n AND p.prefix = f.prefix JOIN f AS g ON g.conv_id = p.conv_id),
s AS (
  SELECT conv_id, string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10)
         || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
  FROM t GROUP BY conv_id)
SELECT h.conv_id, CAST(h.n AS BIGINT) AS n_turns, h.holder AS keep_id, h.holder = h.conv_id AS kept,
       CASE WHEN h.holder = h.conv_id THEN s.rendered END AS rendered
FROM h JOIN s ON s.conv_id = h.conv_id WHERE h.place = 1
"""
