"""Counts, windows and rates per topic.

Every operator is a combining aggregate: a task reduces its rows to one per group before anything
is exchanged, so a topic that holds a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import local_rows

HOUR_MS = 3_600_000
DAY_MS = 86_400_000


def next_offsets(events: DataFrame) -> DataFrame:
    return events.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))


def topic_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("topic").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("timestamp_ms").alias("oldest_timestamp_ms"),
        F.max("timestamp_ms").alias("newest_timestamp_ms"),
    )


def topic_names(events: DataFrame) -> DataFrame:
    return events.select("topic").distinct()


def count_since(events: DataFrame, since_ms: int) -> DataFrame:
    """Events per topic at or after a moment; topics without any show zero."""
    return events.groupBy("topic").agg(F.count_if(F.col("timestamp_ms") >= since_ms).alias("count"))


def list_topics(events: DataFrame, catalog: DataFrame, allowlist: Iterable[str] = ()) -> DataFrame:
    """Topics with counts, window and catalog description.

    With an allowlist exactly its topics appear, unseen ones with count zero. Without one, topics
    that hold events or stand in the catalog appear.
    """
    allowed = sorted(set(allowlist))
    seen = topic_stats(events.filter(F.col("topic").isin(allowed)) if allowed else events)
    described = catalog.select(F.col("name").alias("topic"), "description", "description_confidence")
    if allowed:
        spark = events.sparkSession
        names = local_rows(spark, [(t,) for t in allowed], "topic string")
        rows = names.join(seen, "topic", "left").join(described, "topic", "left")
    else:
        rows = seen.join(described, "topic", "full")
    return rows.select(
        "topic",
        F.coalesce("count", F.lit(0)).alias("count"),
        "oldest_timestamp_ms",
        "newest_timestamp_ms",
        "description",
        "description_confidence",
    )


def activity_profile(events: DataFrame, now_ms: int) -> DataFrame:
    """Last hour, last day, rate and newest event per topic in one pass."""
    ts = F.col("timestamp_ms")
    versions = F.sort_array(F.collect_set("schema_id")) if "schema_id" in events.columns else F.array().cast("array<int>")
    out = events.groupBy("topic").agg(
        F.count_if(ts >= now_ms - HOUR_MS).alias("messages_last_hour"),
        F.count_if(ts >= now_ms - DAY_MS).alias("messages_last_day"),
        *([versions.alias("observed_schema_versions")] if "schema_id" in events.columns else []),
        F.max("timestamp_ms").alias("last_observed_ts_ms"),
    )
    if "schema_id" not in events.columns:
        out = out.withColumn("observed_schema_versions", versions)
    return out.withColumn("rate_per_minute_last_hour", F.col("messages_last_hour") / F.lit(60.0)).select(
        "topic",
        "messages_last_hour",
        "messages_last_day",
        "rate_per_minute_last_hour",
        "observed_schema_versions",
        "last_observed_ts_ms",
    )


def throughput(events: DataFrame, seconds: int = 10) -> DataFrame:
    """Events per topic and time slot."""
    width = seconds * 1000
    slot = F.col("timestamp_ms") - F.pmod(F.col("timestamp_ms"), F.lit(width))
    return events.groupBy("topic", slot.alias("slot_ms")).agg(F.count(F.lit(1)).alias("events"))


def rolling_activity(events: DataFrame, step_ms: int = 60_000) -> DataFrame:
    """Trailing hour and day counts at the end of every minute that saw events.

    Events are first counted per minute; the trailing sums then run over minutes, at most 1,440
    rows of state per day and topic however many events there were.
    """
    slot = F.col("timestamp_ms") - F.pmod(F.col("timestamp_ms"), F.lit(step_ms))
    minutes = events.groupBy("topic", slot.alias("slot_ms")).agg(F.count(F.lit(1)).alias("events"))

    def trailing(span: int) -> Column:
        frame = Window.partitionBy("topic").orderBy("slot_ms").rangeBetween(step_ms - span, 0)
        return F.sum("events").over(frame)

    return minutes.select(
        "topic",
        (F.col("slot_ms") + step_ms).alias("until_ms"),
        trailing(HOUR_MS).alias("messages_last_hour"),
        trailing(DAY_MS).alias("messages_last_day"),
    )


def ingest_counters(decoded: DataFrame) -> DataFrame:
    """Decoded, rejected and total records per topic, with the highest offset reached."""
    ok = F.col("error").isNull()
    return decoded.groupBy("topic").agg(
        F.count_if(ok).alias("messages_ingested"),
        F.count_if(~ok).alias("decode_failures"),
        (F.max("offset") + 1).alias("next_offset"),
    )


# Upper bounds in seconds of the duration histogram.
DURATION_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def refresh_outcomes(run_log: DataFrame, bounds: Sequence[float] = DURATION_BOUNDS) -> DataFrame:
    """Runs per aspect and result with a cumulative duration histogram.

    Counts below fixed bounds merge exactly across tasks, unlike quantiles.
    """
    return run_log.groupBy("aspect", "result").agg(
        F.count(F.lit(1)).alias("runs"),
        F.max("seconds").alias("max_seconds"),
        *[F.count_if(F.col("seconds") <= b).alias(f"le_{i}") for i, b in enumerate(bounds)],
    )
