"""Preference formatting of chat turns, in DataFrame operations only.

A pair has a chosen and a rejected conversation. Their longest common turn prefix (same role and text, turn by turn) is rendered
once as the prompt; what follows in either is its completion. Completions come as segments of rendered text with a mask of the
same length: only what an assistant says, with its end mark, is trained on (mask 1); markers and other roles are masked (0).

Turns count by their order (turn, then role, then text), so gaps and ties in turn numbers are harmless. Of the turns of one
conversation none is dropped; identical rows are turns of their own.

Defined results: null text counts as empty, null role as "user", a null turn sorts first; rows without conv_id belong to no
conversation; a conversation in no pair gives no row; a side of a pair without turns is empty, so the prompt is too; equal
sides have everything in the prompt and empty completions; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table


def opening(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


CLOSING = "<|end|>\n"


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 0 without gaps), role, text."""
    clean = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("user")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return clean.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "role", "text")


def format_preferences(sides: DataFrame) -> DataFrame:
    """sides: pair_id, side ("chosen" or "rejected"), pos, role, text. One row per pair.

    pair_id, n_common, prompt, chosen, rejected (rendered text after the prompt), chosen_mask, rejected_mask: one 0 or 1 for
    each segment of chosen_segments, rejected_segments, which joined are the completion.
    """
    sides = sides.withColumn("turn_key", F.struct("role", "text"))
    per_turn = sides.groupBy("pair_id", "pos").agg(F.max(F.when(F.col("side") == "chosen", F.col("turn_key"))).alias("c"), F.max(F.when(F.col("side") == "rejected", F.col("turn_key"))).alias("r"))
    same = F.col("c").eqNullSafe(F.col("r"))
    unlike = F.coalesce(F.min(F.when(~same, F.col("pos"))), F.max("pos") + 1)
    turns = F.sort_array(F.collect_list(F.struct("pos", "c", "r")))
    both = per_turn.groupBy("pair_id").agg(unlike.alias("n_common"), turns.alias("turns"))
    both = both.withColumn("common", F.slice("turns", 1, F.col("n_common"))).withColumn("rest", F.slice("turns", F.col("n_common") + 1, F.greatest(F.size("turns") - F.col("n_common"), F.lit(0))))
    prompt = F.array_join(F.transform("common", lambda t: F.concat(opening(t["c"]["role"]), t["c"]["text"], F.lit(CLOSING))), "")

    def segments(side: str) -> Column:
        own = F.filter("rest", lambda t: t[side].isNotNull())
        return F.flatten(F.transform(own, lambda t: F.array(opening(t[side]["role"]), F.concat(t[side]["text"], F.lit(CLOSING)))))

    def mask(side: str) -> Column:
        own = F.filter("rest", lambda t: t[side].isNotNull())
        return F.flatten(F.transform(own, lambda t: F.array(F.lit(0), (t[side]["role"] == "assistant").cast("int"))))

    out = both.select("pair_id", F.col("n_common").cast("long").alias("n_common"), prompt.alias("prompt"), segments("c").alias("chosen_segments"), mask("c").alias("chosen_mask"), segments("r").alias("rejected_segments"), mask("r").alias("rejected_mask"))
    return out.withColumn("chosen", F.array_join("chosen_segments", "")).withColumn("rejected", F.array_join("rejected_segments", ""))


def replaced_replies(turns: DataFrame) -> DataFrame:
    """Preference sides from plain conversations: every conversation is chosen; rejected is the same one with its last assistant
    turn answered by the last assistant turn of the conversation whose id differs in the lowest bit (without one: by nothing)."""
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "pos").alias("reply"), F.max("pos").alias("last"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("reply").alias("other"))
    swaps = last.join(other, "conv_id", "left").select("conv_id", "last", "other")
    chosen = turns.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "pos", "role", "text")
    rejected = turns.join(swaps, "conv_id", "left").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "pos", "role", F.when(F.col("pos") == F.col("last"), F.coalesce("other", F.lit(""))).otherwise(F.col("text")).alias("text"))
    return chosen.unionByName(rejected)


def op9_preference_formatting(spark, sf_dir: str) -> DataFrame:
    """A row per conversation: its preference pair as replaced_replies() makes it, rendered."""
    made = format_preferences(replaced_replies(ordered_turns(table(spark, sf_dir, "conversations"))))
    masks = [F.array_join(F.transform(f"{s}_mask", lambda k: k.cast("string")), "").alias(f"{s}_mask") for s in ("chosen", "rejected")]
    return made.select(F.col("pair_id").alias("conv_id"), "n_common", "prompt", "chosen", "rejected", *masks)


OP9_SQL = r"""
WITH t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) - 1 AS pos,
        coalesce(role, 'user') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, arg_max(text, pos) AS reply, max(pos) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
s AS (SELECT a.conv_id, a.last, coalesce(b.reply, '') AS other FROM l a LEFT JOIN l b ON a.conv_id = xor(b.conv_id, 1)),
p AS (
    SELECT t.conv_id, t.pos, t.role, t.text AS c, CASE WHEN t.pos = s.last THEN s.other ELSE t.text END AS r
    FROM t LEFT JOIN s USING (conv_id)),
n AS (SELECT conv_id, coalesce(min(CASE WHEN c <> r THEN pos END), max(pos) + 1) AS n_common FROM p GROUP BY conv_id),
x AS (SELECT p.*, n.n_common, '<|' || role || '|>' || chr(10) AS o, '<|end|>' || chr(10) AS e, CASE WHEN role = 'assistant' THEN '01' ELSE '00' END AS m FROM p JOIN n USING (conv_id))
SELECT conv_id, CAST(max(n_common) AS BIGINT) AS n_common,
    coalesce(string_agg(o || c || e, '' ORDER BY pos) FILTER (pos < n_common), '') AS prompt,
    coalesce(string_agg(o || c || e, '' ORDER BY pos) FILTER (pos >= n_common), '') AS chosen,
    coalesce(string_agg(o || r || e, '' ORDER BY pos) FILTER (pos >= n_common), '') AS rejected,
    coalesce(string_agg(m, '' ORDER BY pos) FILTER (pos >= n_common), '') AS chosen_mask,
    coalesce(string_agg(m, '' ORDER BY pos) FILTER (pos >= n_common), '') AS rejected_mask
FROM x GROUP BY conv_id
"""
