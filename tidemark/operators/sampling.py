"""Recent samples and the values they show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.json_text import scalar_at
from tidemark.session import written_once

SAMPLE_COUNT = 10
#: Coordinates broadcast at most: around 100 bytes each in memory.
MAX_CHOSEN = 200_000


def _choose(events: DataFrame, count: int, rank: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a per-group rank limit to a table of wide rows.

    The rank is decided on coordinates and time alone, so only those columns are read and sorted. The
    few chosen coordinates are then broadcast back to fetch their rows, which on the event table
    reads just the folders they lie in, and those few are ranked once more. Where there are so many topics that ``count`` of each may be
    more than the bound, the same rank runs over the whole rows at once: Spark still applies it inside each task before the exchange.
    """
    # An estimate is enough to choose between two ways to the same rows.
    if count * events.agg(F.approx_count_distinct("topic")).first()[0] > MAX_CHOSEN:
        return rank(events)
    keys = [c for c in ("topic", "partition", "offset_block", "offset") if c in events.columns]
    chosen = written_once(rank(events.select(*keys, "timestamp_ms")).select(keys), "chosen")
    return rank(events.join(F.broadcast(chosen), keys, "left_semi"))


def recent_samples(events: DataFrame, count: int = SAMPLE_COUNT) -> DataFrame:
    """The last ``count`` offsets of every partition, then the newest ``count`` per topic."""
    if count <= 0:
        return events.filter(F.lit(False))
    tail = Window.partitionBy("topic", "partition").orderBy(F.desc("offset"))
    newest = Window.partitionBy("topic").orderBy(F.desc("timestamp_ms"), "partition", F.desc("offset"))

    def rank(rows: DataFrame) -> DataFrame:
        recent = rows.withColumn("_r", F.row_number().over(tail)).filter(F.col("_r") <= count)
        return recent.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= count).drop("_r")

    return _choose(events, count, rank)


def newest_events(events: DataFrame, topic: str, count: int) -> DataFrame:
    """The newest events of one topic, newest first."""
    return (
        events.filter(F.col("topic") == topic)
        .orderBy(F.desc("timestamp_ms"), "partition", F.desc("offset"))
        .limit(count)
    )


def newest_per_topic(events: DataFrame, count: int) -> DataFrame:
    """The newest ``count`` events of every topic with their ``sample_rank``."""
    newest = Window.partitionBy("topic").orderBy(F.desc("timestamp_ms"), "partition", F.desc("offset"))
    return _choose(
        events, count, lambda rows: rows.withColumn("sample_rank", F.row_number().over(newest)).filter(F.col("sample_rank") <= count)
    )


def example_values(rows: DataFrame, value: Column, by: list[str], count: int = 5) -> DataFrame:
    """Up to ``count`` different non-null values per group, most recently seen first, ties by value.

    A value's occurrences collapse to its newest one in a combining hash aggregate before ranking.
    """
    seen = (
        rows.select(*by, value.cast("string").alias("example"), "timestamp_ms")
        .filter(F.col("example").isNotNull())
        .groupBy(*by, "example")
        .agg(F.max("timestamp_ms").alias("seen"))
    )
    rank = Window.partitionBy(*by).orderBy(F.desc("seen"), "example")
    return seen.withColumn("example_rank", F.row_number().over(rank)).filter(F.col("example_rank") <= count).drop("seen")


def example_values_of(samples: DataFrame, field: str, count: int = 5) -> DataFrame:
    """:func:`example_values` for a dotted path inside JSON samples."""
    return example_values(samples, scalar_at(F.col("value_json"), field), ["topic"], count)
