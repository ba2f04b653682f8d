"""Spend ceilings: who may still call the model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import null_safe_join

#: Money is summed as whole billionths, so totals do not depend on the order of addition.
UNITS = 1_000_000_000


def call_cost(
    model: Column, input_tokens: Column, output_tokens: Column,
    prices: Mapping[str, tuple[float, float]], default: tuple[float, float],
) -> Column:
    """USD per call from prices per million tokens; models without a price take the default.

    The price list is a handful of driver-side values and becomes a literal map.
    """
    def price(slot: int) -> Column:
        pairs = [item for name, price in sorted(prices.items()) for item in (F.lit(name), F.lit(float(price[slot])))]
        table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
        return F.coalesce(F.try_element_at(table, model), F.lit(float(default[slot])))

    return (input_tokens * price(0) + output_tokens * price(1)) / F.lit(1_000_000.0)


def units(usd: Column) -> Column:
    return F.round(usd * UNITS).cast("long")


def spend_by_day(ledger: DataFrame) -> DataFrame:
    """Ledger rows summed per (day, provider)."""
    return ledger.groupBy("day", "provider").agg((F.sum(units(F.col("spend_usd"))) / F.lit(float(UNITS))).alias("spend_usd"))


def spent_before(
    calls: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column, cost: Column
) -> DataFrame:
    """Add the running total of ``cost`` before each call as ``spent_units``.

    ``bucket`` must not decrease along ``order`` (a minute, a block of ids). Buckets are totalled by
    a combining aggregate, summed up over the few bucket rows, and only calls of one bucket are put
    in order together: a day or provider that holds a third of all calls is still spread over many
    tasks.
    """
    named = calls.withColumns({"_bucket": bucket, "_units": units(cost)})
    totals = named.groupBy(*by, "_bucket").agg(F.sum("_units").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*by, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.col("_base") + F.coalesce(F.sum("_units").over(inside), F.lit(0))
    return null_safe_join(named, bases, [*by, "_bucket"]).withColumn("spent_units", spent).drop("_bucket", "_units", "_base")


def admit(
    calls: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column, cost: Column, ceiling: float,
) -> DataFrame:
    """Calls made while the spend before them lay under the ceiling; the one that crosses it is allowed."""
    ranked = spent_before(calls, by, order, bucket, cost)
    kept = ranked.filter(F.col("spent_units") < round(ceiling * UNITS))
    return kept.withColumn("spent_before", F.col("spent_units") / F.lit(float(UNITS))).drop("spent_units")


def mark_admitted(calls: DataFrame, key: str, waiting: Column, estimate: float, spent: float, ceiling: float) -> DataFrame:
    """Add ``admitted``: as many waiting calls as fit what is left today, each counted at ``estimate`` USD.

    Calls are taken in hash order of ``key``, which cuts evenly into buckets. Real costs are known
    only afterwards and settle in the ledger. An estimate of nothing would admit everything, so it is
    refused unless the ceiling is infinite.
    """
    left = ceiling - spent
    if left <= 0:
        return calls.withColumn("admitted", F.lit(False))
    if left == float("inf"):
        return calls.withColumn("admitted", waiting)
    if estimate <= 0:
        raise ValueError("a spend ceiling needs a positive estimate of what a call costs")
    ordered = calls.withColumns({"_all": F.lit(0), "_h": F.xxhash64(key)})
    cost = F.when(waiting, F.lit(float(estimate))).otherwise(F.lit(0.0))
    ranked = spent_before(ordered, ["_all"], ["_h", key], F.shiftright("_h", 50), cost)
    return ranked.withColumn("admitted", waiting & (F.col("spent_units") < round(left * UNITS))).drop("_all", "_h", "spent_units")
