"""The event table: idempotent, append-only upserts into Parquet, laid out by day and event coordinates.

Below a table's path lie ``events``, every event as first written, and ``replacements``, later forms of events that were there
already, each with a version. Both are only ever appended to. A reader takes the events without those that were replaced, and
the latest replacements; while there are none, it reads ``events`` as it is. Whatever of a write is visible when a job dies,
nothing that was there before is gone, and the replayed batch finds what did arrive and replaces that.

An event's folder is ``event_date / topic / partition / offset_block``. The broker sets coordinates and timestamp once, so a replayed or
re-embedded event falls into the folder of its earlier copy, and a look-back lists only the folders of its days. Inside a file rows are
sorted by time, so row-group statistics prune further. :func:`compact` copies what a reader sees into fresh files at another path; it
never writes where it reads. With a table format that knows MERGE, use :func:`merge_into` instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ids import event_id, point_id
from tidemark.functions.json_text import json_path
from tidemark.functions.timeparts import floor_div, utc_day
from tidemark.operators.embedding import assert_dim
from tidemark.session import written_once

BLOCK_ROWS = 100_000
LAYOUT = ("event_date", "topic", "partition", "offset_block")
KEYS = (*LAYOUT, "point_id")
EVENTS, REPLACEMENTS = "events", "replacements"
#: Sizes that an id's Bloom filter may take, each half of the one before, from Parquet's maximum down.
BLOOM_SIZES = 14


def latest_per_key(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The last-written row per key. The rank limit is applied inside each task first."""
    last = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_last", F.row_number().over(last)).filter(F.col("_last") == 1).drop("_last")


def merge_rows(target: DataFrame, batch: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Upsert as a query: batch rows win over target rows of the same key."""
    return target.join(batch.select(key), key, "left_anti").unionByName(latest_per_key(batch, key, order))


def stored_form(
    events: DataFrame, promote: Sequence[str] = (), block_rows: int = BLOCK_ROWS, headers: bool = False
) -> DataFrame:
    """Events as stored: ids, day, layout columns and promoted value fields.

    ``promote`` lists value fields that filters use often. As columns of their own they reach the
    Parquet reader, which a condition inside JSON text does not.
    """
    out = events if headers or "headers" not in events.columns else events.drop("headers")
    return out.withColumns(
        {
            "event_id": event_id(),
            "point_id": point_id(event_id()),
            "event_date": utc_day(F.coalesce("timestamp_ms", F.lit(0))),
            "offset_block": floor_div(F.col("offset"), block_rows),
            **{
                f"value_{name.replace('.', '_')}": F.try_variant_get(F.try_parse_json("value_json"), json_path(name), "string")
                for name in promote
            },
        }
    )


def unique_in_folders(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The last-written row per event, with the rows of a block side by side.

    Topic, partition and block determine the partitioning and are part of the identity, so finding duplicates needs no second
    exchange. A block holds a bounded number of offsets, so no topic, however large, becomes one task.
    """
    block = LAYOUT[1:]
    last = Window.partitionBy(*block, "point_id").orderBy(*order)
    return rows.repartition(*block).withColumn("_last", F.row_number().over(last)).filter(F.col("_last") == 1).drop("_last")


def _append(rows: DataFrame, folder: str, bloom: Sequence[str]) -> None:
    writer = rows.sortWithinPartitions(*LAYOUT, "timestamp_ms").write.mode("append").partitionBy(*LAYOUT)
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.candidates.number#{column}", str(BLOOM_SIZES))
    # Filters are sized by the ids a file holds; without, each has Parquet's maximum of 1 MB, many times the rows of a small file.
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(folder)


def exists(spark: SparkSession, folder: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def day_folders(spark: SparkSession, folder: str, first: date | None = None, last: date | None = None) -> list[str]:
    """Folders of the days from ``first`` to ``last`` that exist, oldest first; one listing of the level of days."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(where))
    days = {n: date.fromisoformat(n.removeprefix("event_date=")) for n in names if n.startswith("event_date=")}
    return [f"{folder}/{n}" for n, day in days.items() if (first is None or day >= first) and (last is None or day <= last)]


def _scan(spark: SparkSession, folder: str, first: date | None = None, last: date | None = None) -> DataFrame | None:
    """Rows of the given days, or None where there are none. Folder names keep their declared types."""
    days = day_folders(spark, folder, first, last)
    if not days:
        return None
    reader = spark.read.option("basePath", folder)
    kinds = {"event_date": T.DateType(), "topic": T.StringType(), "partition": T.IntegerType(), "offset_block": T.LongType()}
    # The newest day has the columns that were added last.
    typed = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in reader.parquet(days[-1]).schema])
    return spark.read.option("basePath", folder).schema(typed).parquet(*days)


def _day(ms: int | None) -> date | None:
    return None if ms is None else datetime.fromtimestamp(ms / 1000, timezone.utc).date()


def latest_replacements(replaced: DataFrame) -> DataFrame:
    return latest_per_key(replaced, "point_id", [F.desc("version")])


def read(spark: SparkSession, path: str, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame | None:
    """The stored events, or None before the first write; of the days from ``since_ms`` to ``until_ms`` only, if given.

    The bounds choose whole days; put the exact condition on the rows.
    """
    days = (_day(since_ms), _day(until_ms))
    events, replaced = _scan(spark, f"{path}/{EVENTS}", *days), _scan(spark, f"{path}/{REPLACEMENTS}", *days)
    if events is None or replaced is None:
        return events
    return replace_rows(events, replaced)


def replace_rows(events: DataFrame, replaced: DataFrame) -> DataFrame:
    """Events with the latest of their replacements; an event that only stands among these counts too."""
    latest = latest_replacements(replaced).drop("version")
    left = events.join(replaced.select(*KEYS).distinct(), list(KEYS), "left_anti").select(*events.columns)
    return left.unionByName(latest, allowMissingColumns=True)


def upsert(
    batch: DataFrame,
    path: str,
    dim: int | None = None,
    order: Sequence[Column] | None = None,
    bloom: Sequence[str] = ("point_id",),
    unique: bool = False,
) -> str:
    """Write a batch in :func:`stored_form`; returns ``append`` or ``replace``. One writer at a time.

    The batch's ids are compared with those stored in its days and blocks of offsets. New events are appended; events that are there
    already (a replay, or an event embedded anew) are appended to the replacements, where they win. ``unique`` says that the batch went
    through :func:`unique_in_folders` already. Where the table has a vector index, its cells follow.
    """
    from tidemark.plans import vector_index

    if dim is not None:
        batch = assert_dim(batch, dim)
    spark = batch.sparkSession
    fresh = batch if unique else unique_in_folders(batch, order or [F.desc("timestamp_ms")])
    if not day_folders(spark, f"{path}/{EVENTS}"):
        return _append_new(fresh, path, bloom)
    # Finding an event's folder and its earlier copies takes an exchange and a sort: once, for all that asks about keys.
    keys = written_once(batch.select(*KEYS), "batch-keys")
    known = _known(keys, path)
    known = None if known is None else written_once(known.distinct(), "known-events")
    if known is None or known.isEmpty():
        return _append_new(fresh, path, bloom)
    if known.count() == (keys if unique else keys.distinct()).count():
        new, again = None, fresh
    else:
        # A join deals rows out by id; a folder's rows go back to one task, so that it gets one file and not one of every task.
        new, again = (fresh.join(known, list(KEYS), how).repartition(*LAYOUT[1:]) for how in ("left_anti", "left_semi"))
        _append(new, f"{path}/{EVENTS}", bloom)
    earlier = _scan(spark, f"{path}/{REPLACEMENTS}")
    # One number; the latest version counts, so a replay of a write that died half-way wins over what it left.
    version = 1 + ((earlier.agg(F.max("version")).first()[0] or 0) if earlier is not None else 0)
    again = again.withColumn("version", F.lit(version).cast("long"))
    _append(again, f"{path}/{REPLACEMENTS}", bloom)
    if new is not None:
        again = new.withColumn("version", F.lit(0).cast("long")).unionByName(again)
    vector_index.add(spark, path, again)
    return "replace"


def _append_new(rows: DataFrame, path: str, bloom: Sequence[str]) -> str:
    from tidemark.plans import vector_index

    _append(rows, f"{path}/{EVENTS}", bloom)
    vector_index.add(rows.sparkSession, path, rows.withColumn("version", F.lit(0).cast("long")))
    return "append"


def _known(batch: DataFrame, path: str) -> DataFrame | None:
    """Keys of the batch that are stored. Only the batch's days are listed, only its blocks of offsets read, and of these the ids."""
    bounds = batch.agg(*[f(c).alias(f"{n}_{c}") for c in ("event_date", "offset_block") for n, f in (("low", F.min), ("high", F.max))]).first()
    if bounds.low_event_date is None:
        return None
    stored = _scan(batch.sparkSession, f"{path}/{EVENTS}", bounds.low_event_date, bounds.high_event_date)
    if stored is None:
        return None
    near = stored.filter(F.col("offset_block").between(bounds.low_offset_block, bounds.high_offset_block))
    return near.select(*KEYS).join(batch.select(*KEYS), list(KEYS), "left_semi")


def compact(spark: SparkSession, path: str, target: str, first: date | None = None, last: date | None = None) -> None:
    """Copy what a reader sees, of the given days or of all, into fresh, larger files at ``target``; replacements take their events' places.

    Readers and writers change over to ``target`` when it is complete. Folders are dealt out by size, so that a large one is several
    files and many small ones share a task.
    """
    events, replaced = _scan(spark, f"{path}/{EVENTS}", first, last), _scan(spark, f"{path}/{REPLACEMENTS}", first, last)
    if events is None:
        return
    rows = events if replaced is None else replace_rows(events, replaced)
    _append(rows.hint("rebalance", *LAYOUT), f"{target}/{EVENTS}", ("point_id",))


def merge_into(batch: DataFrame, table: str) -> None:
    """Upsert through a table format that supports MERGE (Delta, Iceberg, ...)."""
    fresh = latest_per_key(batch, "point_id", [F.desc("timestamp_ms")]).alias("s")
    fresh.mergeInto(table, F.expr(f"{table}.point_id = s.point_id")).whenMatched().updateAll().whenNotMatched().insertAll().merge()

