"""Table layouts of the event store and the topic catalog."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # type: ignore[return-value]


RAW = (
    "topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP, key BINARY, value BINARY, "
    "headers ARRAY<STRUCT<key: STRING, value: BINARY>>"
)
EVENT = (
    "topic STRING, partition INT, offset BIGINT, timestamp_ms BIGINT, key STRING, "
    "headers MAP<STRING, STRING>, schema_id INT, value_json STRING"
)
REGISTRY = "subject STRING, version INT, schema_id INT, schema_json STRING"
TOPICS = (
    "name STRING, schema_subject STRING, schema_id INT, schema_version INT, schema_fingerprint STRING, "
    "raw_schema_json STRING, description STRING, description_confidence DOUBLE, inference_status STRING, "
    "last_schema_refresh_ms BIGINT, last_sample_refresh_ms BIGINT, last_stats_refresh_ms BIGINT, "
    "last_inference_refresh_ms BIGINT"
)
FIELDS = "topic STRING, name STRING, type STRING, nullable BOOLEAN, default_json STRING, doc STRING"
ANNOTATIONS = "topic STRING, name STRING, inferred_meaning STRING, inferred_confidence DOUBLE"
SAMPLES = "topic STRING, partition INT, offset BIGINT, timestamp_ms BIGINT, key STRING, value_json STRING"
ACTIVITY = (
    "topic STRING, messages_last_hour BIGINT, messages_last_day BIGINT, rate_per_minute_last_hour DOUBLE, "
    "observed_schema_versions ARRAY<INT>, last_observed_ts_ms BIGINT"
)
RELATIONSHIPS = (
    "source_topic STRING, target_topic STRING, relationship_type STRING, source_field STRING, "
    "target_field STRING, confidence DOUBLE, rationale STRING, last_refresh_ms BIGINT"
)
ANNOTATION_CACHE = "cache_key STRING, payload_json STRING, created_ms BIGINT"
SPEND = "day DATE, provider STRING, spend_usd DOUBLE"
RUN_LOG = "aspect STRING, result STRING, seconds DOUBLE, error STRING, topic STRING"

#: Columns of an event that are addressed by their own name in filters.
CORE_COLUMNS = ("topic", "partition", "offset", "timestamp_ms", "key")
