"""Kafka as a Structured Streaming source, and file streams of the same shape."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas

PROTOCOLS = ("PLAINTEXT", "SSL", "SASL_PLAINTEXT", "SASL_SSL")


def security_options(
    protocol: str = "PLAINTEXT",
    mechanism: str = "",
    username: str = "",
    password: str = "",
    truststore: str = "",
    keystore: str = "",
    key_password: str = "",
) -> dict[str, str]:
    """Reader/writer options for the broker connection; empty for PLAINTEXT."""
    if protocol not in PROTOCOLS:
        raise ValueError(f"unknown security protocol {protocol!r}")
    if protocol == "PLAINTEXT":
        return {}
    options = {"kafka.security.protocol": protocol}
    if protocol.startswith("SASL"):
        mechanism = mechanism or "PLAIN"
        options["kafka.sasl.mechanism"] = mechanism
        if username:
            module = "scram.ScramLoginModule" if mechanism.startswith("SCRAM") else "plain.PlainLoginModule"
            quoted = [text.replace("\\", "\\\\").replace('"', '\\"') for text in (username, password)]
            options["kafka.sasl.jaas.config"] = (
                f"org.apache.kafka.common.security.{module} required "
                f'username="{quoted[0]}" password="{quoted[1]}";'
            )
    if protocol.endswith("SSL"):
        files = {
            "kafka.ssl.truststore.location": truststore,
            "kafka.ssl.keystore.location": keystore,
        }
        for option, path in files.items():
            if path:
                options[option] = path
                options[option.replace("location", "type")] = "PEM"
        if key_password:
            options["kafka.ssl.key.password"] = key_password
    return options


def registry_options(
    url: str, user: str = "", password: str = "", truststore: str = ""
) -> dict[str, str]:
    """Connection map for whatever job exports the schema registry to a table."""
    options = {"url": url}
    if user:
        options["basic.auth.user.info"] = f"{user}:{password}"
    if truststore:
        options["ssl.ca.location"] = truststore
    return options


def source_options(
    servers: str,
    topics: Sequence[str],
    start: str = "earliest",
    max_per_trigger: int | None = None,
    security: dict[str, str] | None = None,
    min_per_trigger: int | None = None,
    max_delay: str | None = None,
) -> dict[str, str]:
    """Options of the stream. ``min_per_trigger`` and ``max_delay`` flush by size or age: a micro-batch starts when that many records
    wait, or when the last one lies that far back (``"1s"``, ``"15m"``), whichever comes first; ``max_per_trigger`` bounds it above."""
    names = [t.strip() for t in topics if t.strip()]
    if not names:
        raise ValueError("name at least one topic")
    if start not in ("earliest", "latest"):
        raise ValueError("start must be 'earliest' or 'latest'")
    if (min_per_trigger is None) != (max_delay is None):
        raise ValueError("a least batch size needs a longest delay, and the other way round")
    if min_per_trigger is not None and max_per_trigger is not None and min_per_trigger > max_per_trigger:
        raise ValueError("the least batch size exceeds the largest")
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(names),
        "startingOffsets": start,
        "includeHeaders": "true",
        "failOnDataLoss": "true",
        **(security or {}),
    }
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    if min_per_trigger:
        options |= {"minOffsetsPerTrigger": str(min_per_trigger), "maxTriggerDelay": str(max_delay)}
    return options


def sample_options(servers: str, next_offsets: DataFrame, count: int, security: dict[str, str] | None = None) -> dict[str, str]:
    """Options of a batch read of the last ``count`` offsets of every partition.

    ``next_offsets`` has topic, partition and next_offset (``activity.next_offsets``), one row per broker partition. Compacted or
    expired offsets make the read shorter, not longer.
    """
    if count < 1:
        raise ValueError("sample at least one offset")
    rows = next_offsets.orderBy("topic", "partition").collect()  # one per broker partition
    if not rows:
        raise ValueError("no partition to sample")
    first: dict[str, dict[str, int]] = {}
    last: dict[str, dict[str, int]] = {}
    for r in rows:
        first.setdefault(r.topic, {})[str(r.partition)] = max(0, r.next_offset - count)
        last.setdefault(r.topic, {})[str(r.partition)] = r.next_offset
    return {
        "kafka.bootstrap.servers": servers,
        "assign": json.dumps({t: [int(p) for p in parts] for t, parts in first.items()}),
        "startingOffsets": json.dumps(first),
        "endingOffsets": json.dumps(last),
        "includeHeaders": "true",
        "failOnDataLoss": "false",
        **(security or {}),
    }


def read_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Raw records of the subscribed topics. Needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**options).load().select(
        "topic", "partition", "offset", "timestamp", "key", "value", "headers"
    )


def batch_options(options: dict[str, str]) -> dict[str, str]:
    """Options without what only a stream knows. A batch from the latest offset on would be empty, so that is an error."""
    if options.get("startingOffsets") == "latest":
        raise ValueError("a bounded read cannot start at the latest offset; name offsets, or use sample_options")
    return {k: v for k, v in options.items() if k not in ("maxOffsetsPerTrigger", "minOffsetsPerTrigger", "maxTriggerDelay")}


def read_batch(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """The same records as a bounded read (for samplers and back-fills)."""
    bounded = batch_options(options)
    return spark.read.format("kafka").options(**bounded).load().select(
        "topic", "partition", "offset", "timestamp", "key", "value", "headers"
    )


def read_files(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None, bytes_per_trigger: int | None = None
) -> DataFrame:
    """A stream over files that hold raw records, for replays and tests; a micro-batch ends at that many files or bytes."""
    reader = spark.readStream.schema(schemas.RAW).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.load(path)


def letter_topic(servers: str, topic: str, security: dict[str, str] | None = None):
    """A dead-letter sink for the ingest job that publishes rejects to a topic."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, **(security or {})}

    def write(rejects: DataFrame, _: int) -> None:
        dead_letter_records(rejects).write.format("kafka").options(**options).save()

    return write


def dead_letter_records(rejects: DataFrame) -> DataFrame:
    """Rejected records in the shape of the Kafka sink: raw bytes plus origin headers."""
    def header(name: str, column: str):
        return F.struct(F.lit(name).alias("key"), F.encode(F.col(column).cast("string"), "UTF-8").alias("value"))

    # The header names readers of the dead-letter topic expect.
    return rejects.select(
        F.col("raw_key").alias("key"),
        F.col("raw_value").alias("value"),
        F.array(
            header("sc_origin_topic", "topic"),
            header("sc_origin_partition", "partition"),
            header("sc_origin_offset", "offset"),
            header("sc_error", "error"),
        ).alias("headers"),
    )
