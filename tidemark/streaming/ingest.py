"""The ingest stream: raw records in, embedded events and dead letters out."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import privacy
from tidemark.functions.json_text import canonical_json
from tidemark.operators.activity import ingest_counters
from tidemark.operators.embedding import embed_column, normalized, probe_dim
from tidemark.plans import store
from tidemark.sources import envelope

RETRIES = 3


#: Says that rejects may go unkept; they are counted all the same.
DROP = object()


@dataclass(frozen=True)
class Job:
    """Settings of an ingest job.

    ``registry`` may be a function that reads the latest snapshot for each batch.
    ``drop_fields`` are removed before the text is made, so they reach neither payload nor vector.
    ``sink(events, batch_id)`` and ``dead_letters(rejects, batch_id)`` may be any writer; a job without a place for
    its rejects must say so with ``DROP``. ``counters(rows, batch_id)`` gets the batch's records by topic, good and bad.
    ``bodies`` is the decode strategy (``envelope.json_bodies``, ``envelope.avro_bodies()``).
    """

    registry: DataFrame | Callable[[], DataFrame]
    embedder: object
    sink: Callable[[DataFrame, int], None]
    dead_letters: Callable[[DataFrame, int], None] | object | None = None
    drop_fields: tuple[str, ...] = ()
    include_headers: bool = False
    promote: tuple[str, ...] = ()
    bodies: envelope.Bodies = envelope.json_bodies
    counters: Callable[[DataFrame, int], None] | None = None


def event_table(path: str, dim: int) -> Callable[[DataFrame, int], None]:
    """A sink that upserts into the event table at ``path``."""

    def write(events: DataFrame, _: int) -> None:
        store.upsert(events, path, dim, unique=True)

    return write


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink with one folder per query and batch: a replayed batch replaces its own rows, another checkpoint's batches stay."""

    def write(rows: DataFrame, batch_id: int) -> None:
        query = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        rows.write.mode("overwrite").parquet(f"{path}/query={query}/batch={batch_id}")

    return write


def letter_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A dead-letter sink into files."""
    return batch_folder(path)


def counter_totals(counters: DataFrame) -> DataFrame:
    """Totals by topic over everything that ``counters`` sinks wrote, so over restarts as well."""
    return counters.groupBy("topic").agg(
        F.sum("messages_ingested").alias("messages_ingested"), F.sum("decode_failures").alias("decode_failures"), F.max("next_offset").alias("next_offset")
    )


def prepare(decoded: DataFrame, job: Job) -> tuple[DataFrame, DataFrame]:
    """(events ready to store, rejects) of decoded records.

    Records are put next to their folder's others and made unique while they are still small;
    text and vector are made afterwards, so vectors are never exchanged. Vectors are stored at unit length, as floats.
    """
    events = envelope.good(decoded)
    if job.drop_fields:
        events = events.withColumn("value_json", privacy.redact_json(F.col("value_json"), job.drop_fields))
        events = events.withColumn("headers", F.map_filter("headers", lambda k, _: ~k.isin(*job.drop_fields)))
    stored = store.stored_form(events, job.promote, headers=job.include_headers)
    stored = store.unique_in_folders(stored, [F.desc("timestamp_ms")])
    stored = stored.withColumn("text", canonical_json(F.col("value_json")))
    stored = normalized(stored.withColumn("embedding", embed_column(job.embedder, F.col("text"))))
    return stored, envelope.rejects(decoded)


def retrying(action: Callable[[], None], attempts: int = RETRIES, first_wait: float = 0.5, longest: float = 4.0) -> None:
    """Run an action with exponential pauses; the last failure stops the stream, nothing is skipped."""
    for attempt in range(attempts):
        try:
            return action()
        except Exception:
            if attempt == attempts - 1:
                raise
            time.sleep(min(longest, first_wait * 2**attempt))


def start(
    raw: DataFrame,
    job: Job,
    checkpoint: str,
    trigger: dict | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Start the stream. Offsets advance only after the sink has written a batch.

    Together with ids derived from coordinates a replayed batch leaves the table unchanged. The
    embedder's vector length is checked before the first record is read. Records and tombstones per batch are
    observed metrics and show up in the query progress; failures by topic go to ``job.counters``.
    ``trigger`` is how often new records are looked for; how many make a batch, and how long fewer may wait, is the source's
    (``kafka.source_options``).
    """
    if job.dead_letters is None:
        raise ValueError("name a sink for records that cannot be decoded, or DROP")
    if hasattr(job.embedder, "embed"):
        probe_dim(job.embedder, job.embedder.dim)
    counted = raw.observe(
        "ingest", F.count(F.lit(1)).alias("records"), F.count_if(F.col("value").isNull()).alias("tombstones")
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        registry = job.registry() if callable(job.registry) else job.registry
        kept = envelope.decode(batch, registry, job.bodies).persist()
        try:
            events, rejects = prepare(kept, job)
            retrying(lambda: job.sink(events, batch_id))
            if job.dead_letters is not DROP:
                retrying(lambda: job.dead_letters(rejects, batch_id))
            if job.counters is not None:
                retrying(lambda: job.counters(ingest_counters(kept), batch_id))
        finally:
            kept.unpersist()

    writer = counted.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of an event id inside a stream while they fall within the watermark."""
    timed = events.withColumn("event_time", F.timestamp_millis("timestamp_ms"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def committed(progress: Sequence[dict]) -> dict[str, int]:
    """Totals over the progress reports of a query."""
    totals = {"records": 0, "tombstones": 0, "batches": 0}
    for report in progress:
        seen = (report.get("observedMetrics") or {}).get("ingest") or {}
        totals["records"] += int(seen.get("records", 0))
        totals["tombstones"] += int(seen.get("tombstones", 0))
        totals["batches"] += 1
    return totals
