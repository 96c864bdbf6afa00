"""Preference formatting of chosen and rejected conversations.

The turns that both conversations of a pair begin with are rendered once as
prompt. What follows in each is its completion, rendered turn by turn with a
mask: only turns of the ``assistant`` count for the loss, and of these the text
and the end mark, not the header. ``segments`` tell text from mask; joined they
are the completion.

Edge cases. A turn without role is the user's, one without text is empty, one
without number comes first. Turns that repeat in full count once; of different
turns with one number the order is by role, then text. If one conversation
begins with all of the other, the shorter completion is empty; two equal
conversations are all prompt. A pair of which one side is missing is no
preference: it is left out of ``format_pairs`` and given back by ``unpaired``.
Turns without pair id are left out. Empty tables give empty results. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|end|>\n"))


def conversations(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """``pair_id, chosen, turns``: each conversation's turns in order.

    A conversation is one training example and is rendered as one text, so its
    turns meet in one row; pairs are never gathered.
    """
    rows = turns.select(
        pair.alias("pair_id"), chosen.alias("chosen"), F.col("turn"),
        F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).filter(F.col("pair_id").isNotNull() & F.col("chosen").isNotNull())
    # A set keeps repeated turns out before they are shuffled.
    return rows.groupBy("pair_id", "chosen").agg(
        F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns")
    ).withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), shorter), F.slice(b, F.lit(1), shorter), lambda x, y: x == y)
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, shorter).cast("int")


def segments(turns: Column) -> Column:
    """``text, mask`` of a completion: 1 where the loss counts."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(_header(t).alias("text"), F.lit(0).alias("mask")),
        F.struct(_body(t).alias("text"), (t["role"] == LOSS_ROLE).cast("int").alias("mask")))))


def format_pairs(sides: DataFrame) -> DataFrame:
    """``pair_id, n_shared, prompt, chosen, rejected`` from ``conversations``.

    ``chosen`` and ``rejected`` are arrays of ``text, mask``.
    """
    a = sides.filter("chosen").select("pair_id", F.col("turns").alias("a"))
    b = sides.filter("not chosen").select("pair_id", F.col("turns").alias("b"))
    both = a.join(b, "pair_id").withColumn("n_shared", common_turns(F.col("a"), F.col("b")))

    def rest(turns: str) -> Column:
        return segments(F.slice(turns, F.col("n_shared") + 1, F.size(turns)))

    prompt = F.transform(F.slice("a", F.lit(1), F.col("n_shared")), lambda t: F.concat(_header(t), _body(t)))
    return both.select(
        "pair_id", "n_shared", F.array_join(prompt, "").alias("prompt"), rest("a").alias("chosen"), rest("b").alias("rejected"))


def unpaired(sides: DataFrame) -> DataFrame:
    """``pair_id, chosen, turns`` of conversations without a partner."""
    other = sides.select(F.col("pair_id").alias("p"), (~F.col("chosen")).alias("c"))
    return sides.join(other, (F.col("pair_id") == F.col("p")) & (F.col("chosen") == F.col("c")), "left_anti")


def joined(side: Column) -> Column:
    return F.array_join(F.transform(side, lambda s: s["text"]), "")


def loss_chars(side: Column) -> Column:
    """Characters that count for the loss."""
    return F.aggregate(side, F.lit(0).cast("long"), lambda n, s: n + s["mask"] * F.char_length(s["text"]))


def report(turns: DataFrame) -> DataFrame:
    """Pairs of neighbouring conversations: the even id is the chosen one."""
    conv = F.col("conv_id")
    pairs = format_pairs(conversations(turns, F.shiftright(conv.cast("long"), 1), F.pmod(conv, F.lit(2)) == 0))
    return pairs.select(
        "pair_id", F.col("n_shared").cast("long"), "prompt", joined(F.col("chosen")).alias("chosen"),
        joined(F.col("rejected")).alias("rejected"), loss_chars(F.col("chosen")).alias("chosen_loss_chars"),
        loss_chars(F.col("rejected")).alias("rejected_loss_chars"))
