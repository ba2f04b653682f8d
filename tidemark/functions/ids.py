"""Event identity: ``topic:partition:offset``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_id(topic="topic", partition="partition", offset="offset") -> Column:
    return F.concat_ws(":", F.col(topic), F.col(partition).cast("string"), F.col(offset).cast("string"))


def point_id(identity: Column) -> Column:
    """A UUID-shaped id: the first 32 hex digits of SHA-256, grouped 8-4-4-4-12."""
    digest = F.sha2(identity, 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def with_ids(events: DataFrame) -> DataFrame:
    return events.withColumn("event_id", event_id()).withColumn("point_id", point_id(F.col("event_id")))


def parse_reference(reference: Column) -> Column:
    """``topic:partition:offset`` read from the right; null unless every part is valid.

    The topic may itself hold colons; partition and offset must be non-negative integers.
    """
    pattern = r"^(?s)(.+):(\d+):(\d+)$"
    part = F.regexp_extract(reference, pattern, 2).try_cast("int")
    offset = F.regexp_extract(reference, pattern, 3).try_cast("bigint")
    parsed = F.struct(
        F.regexp_extract(reference, pattern, 1).alias("topic"),
        part.alias("partition"),
        offset.alias("offset"),
    )
    return F.when(reference.rlike(pattern) & part.isNotNull() & offset.isNotNull(), parsed)
