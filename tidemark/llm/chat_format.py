"""Chat formatting (operator 5): cumulative snapshots of a conversation collapse to the longest, which is rendered.

A client that logs the whole history after every turn leaves many conversations that are prefixes of longer ones.
Every turn gets the hash of all turns up to it: a running XOR of the turn's place, role and text hashed with two
seeds (128 bits), which needs no list of turns. Equal full hashes are one row, that of the smallest id; an anti-join with the distinct
hashes of proper prefixes, so that a first turn shared by a third of all conversations is one row, leaves the maximal conversations.
Only their texts are collected and rendered.

Places and running hashes are made in two levels, inside ranges of ``1 << RANGE_BITS`` turn numbers and over the ranges of a conversation, so
that a conversation with a third of all turns is many tasks until its text is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

START, END = "<|im_start|>", "<|im_end|>"


RANGE_BITS = 10
#: Range of turns without a number, before all others.
_NO_TURN = -(1 << 60)
_RANGE = ["conv_id", "range"]


def _over_ranges(per_range: DataFrame, **columns: Column) -> DataFrame:
    """Aggregates of what stands in a conversation's ranges before each range, under new names."""
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select(*_RANGE, *[F.coalesce(c.over(before), F.lit(0)).alias(n) for n, c in columns.items()])


def _turns(turns: DataFrame) -> DataFrame:
    """Turns with their place (from 1) in the conversation, in the order turn, role, text; nulls first."""
    chosen = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where(F.col("conv_id").isNotNull()).withColumn("range", F.coalesce(F.shiftright("turn", RANGE_BITS), F.lit(_NO_TURN)))
    counts = chosen.groupBy(*_RANGE).agg(F.count("*").alias("n"))
    inside = F.row_number().over(Window.partitionBy(*_RANGE).orderBy("turn", "role", "text"))
    return chosen.join(_over_ranges(counts, earlier=F.sum("n")), _RANGE).withColumn("place", inside + F.col("earlier")).drop("earlier")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place, a and b (hash of all turns up to this place) of every turn, and ``last``: whether the conversation ends here."""
    hashed = _turns(turns).select(
        *_RANGE, "place", F.xxhash64("place", F.lit(1), "role", F.lit(2), "text").alias("a"),
        F.xxhash64(F.lit(3), "text", "place", F.lit(4), "role").alias("b"),
    )
    totals = hashed.groupBy(*_RANGE).agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    bases = _over_ranges(totals, base_a=F.bit_xor("a"), base_b=F.bit_xor("b"))
    ends = hashed.groupBy("conv_id").agg(F.max("place").alias("n"))
    so_far = Window.partitionBy(*_RANGE).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolling = [F.bit_xor(c).over(so_far).bitwiseXOR(F.col(f"base_{c}")).alias(c) for c in ("a", "b")]
    return hashed.join(bases, _RANGE).select("conv_id", "place", *rolling).join(ends, "conv_id").withColumn("last", F.col("place") == F.col("n")).drop("n")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no proper prefix of another one; one of each set of equal ones.

    Turns without a conversation take no part; null turn numbers come first, null roles and texts count as empty. An empty table gives none.
    """
    rolling = written(prefixes(turns), "turn-prefixes")
    whole = rolling.where("last").groupBy("place", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    inner = rolling.where(~F.col("last")).select("place", "a", "b").distinct()
    return whole.join(inner, ["place", "a", "b"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and ``chat`` (turns between start and end marks) of every maximal conversation.

    Turns without a conversation are left out; null roles and texts count as empty; repeated turns stay, one after another.
    """
    kept = maximal(turns)
    lines = _turns(turns).select(
        "conv_id", "place", F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END)).alias("line")
    ).join(kept, "conv_id", "left_semi")
    chats = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return chats.select("conv_id", F.size("lines").cast("long").alias("n_turns"), F.array_join("lines.line", "\n").alias("chat"))
