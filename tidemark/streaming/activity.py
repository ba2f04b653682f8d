"""Streaming counts per topic. Late rows still reach the event table; they only miss a closed window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def throughput(events: DataFrame, slot: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Events per topic and time slot."""
    timed = events.withColumn("event_time", F.timestamp_millis("timestamp_ms")).withWatermark("event_time", delay)
    counts = timed.groupBy("topic", F.window("event_time", slot)).agg(F.count(F.lit(1)).alias("events"))
    return counts.select("topic", F.unix_millis("window.start").alias("slot_ms"), "events")


def rolling(events: DataFrame, span: str = "1 hour", step: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Trailing counts per topic at every step.

    Events are counted per step first and the sliding window runs over those counts, so one event
    is not copied into every window it lies in.
    """
    timed = events.withColumn("event_time", F.timestamp_millis("timestamp_ms")).withWatermark("event_time", delay)
    steps = timed.groupBy("topic", F.window("event_time", step)).agg(F.count(F.lit(1)).alias("events"))
    steps = steps.select("topic", F.window_time("window").alias("at"), "events")
    out = steps.groupBy("topic", F.window("at", span, step)).agg(F.sum("events").alias("events"))
    return out.select("topic", F.unix_millis("window.end").alias("until_ms"), "events")
