"""Preference formatting, with DataFrame functions only.

A pair has two conversations, chosen and rejected, as arrays of turns (role, text). Their longest common prefix of
turns is rendered once as the prompt; the rest of each is a completion. A completion's mask is a list of runs
(trained, length in characters) that together cover it: a turn's opening is masked, the text and end mark of an
assistant's turn are trained, and everything of other roles is masked.

Rendering: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn; a text that holds ``<|im_`` gets it as ``<| im_``,
so that texts can't open or end turns.

Defined cases: null roles and texts equal one another and render as empty; a null conversation has no turns;
conversations that are alike have empty completions; without a common first turn the prompt is empty; turns of one
number are ordered by role and text, repeated ones kept; a conversation without an assistant's turn is chosen
whole; an empty table gives an empty result; other columns are ignored; texts of any length are kept whole. A
conversation is one row, as its rendering is, so that one of very many turns needs memory for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.cluster import take

ROLE = "assistant"
TURNS = "array<struct<role: string, text: string>>"


def _plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def _opening(turn: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), _plain(turn["role"]), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_plain(turn["text"]), F.lit("<|im_end|>"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_opening(t), _body(t), F.lit("\n"))), "")


def mask(turns: Column) -> Column:
    """Runs (trained, length) of the rendered turns."""
    run = lambda trained, text: F.struct(trained.alias("trained"), F.char_length(text).cast("long").alias("length"))
    return F.flatten(F.transform(turns, lambda t: F.array(run(F.lit(False), _opening(t)), run(F.coalesce(t["role"] == ROLE, F.lit(False)), _body(t)), run(F.lit(False), F.lit("\n")))))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of turns that both arrays begin with."""
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("long")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, n_prefix_turns, prompt, and completion and mask of chosen and rejected, for ``pairs`` (pair_id, chosen,
    rejected: TURNS)."""
    turns = lambda c: F.coalesce(F.col(c), F.array().cast(TURNS)).alias(c)
    rows = take(pairs, "pair_id", "chosen", "rejected").select("pair_id", turns("chosen"), turns("rejected")).withColumn("n_prefix_turns", common_prefix(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(F.col(c), F.col("n_prefix_turns").cast("int") + 1, F.size(c))
    rows = rows.select("pair_id", "n_prefix_turns", F.slice("chosen", F.lit(1), F.col("n_prefix_turns").cast("int")).alias("prefix"), rest("chosen").alias("chosen"), rest("rejected").alias("rejected"))
    return rows.select("pair_id", "n_prefix_turns", render(F.col("prefix")).alias("prompt"), render(F.col("chosen")).alias("chosen"), mask(F.col("chosen")).alias("chosen_mask"), render(F.col("rejected")).alias("rejected"), mask(F.col("rejected")).alias("rejected_mask"))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and the ordered turns of each conversation of ``turns`` (conv_id, turn, role, text)."""
    turns = take(turns, "conv_id", "turn", "role", "text")
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def swapped_answers(turns: DataFrame) -> DataFrame:
    """Pairs from conversations that have no rejected side: chosen is a conversation up to its last answer, rejected
    the same with the last answer of the conversation of the next conv_id in place of its own, or none."""
    turns = take(turns, "conv_id", "turn", "role", "text")
    held = conversations(turns)
    at = F.coalesce(F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == ROLE, i + 1))), F.lit(0))
    donors = turns.where(F.col("role") == ROLE).groupBy((F.col("conv_id") - 1).alias("conv_id")).agg(F.max(F.struct("turn", "text")).alias("answer"))
    rows = held.withColumn("at", at).join(donors, "conv_id", "left")
    plain = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    own = F.when(F.col("at") == 0, F.col("turns")).otherwise(F.slice("turns", F.lit(1), F.col("at")))
    before = F.slice("turns", F.lit(1), F.greatest(F.col("at") - 1, F.lit(0)))
    other = F.when(F.col("answer").isNull(), F.array().cast(TURNS)).otherwise(F.array(F.struct(F.lit(ROLE).alias("role"), F.col("answer.text").alias("text"))))
    return rows.select(F.col("conv_id").alias("pair_id"), plain(own).alias("chosen"), F.concat(plain(before), other).alias("rejected"))
