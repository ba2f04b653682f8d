"""A vector index beside the event table: every stored vector in the cell of its nearest pivot, by its angle to that pivot.

``pivots`` is a small table, written once; ``cells`` holds coordinates, version, radius and vector of every event, one folder per cell and
sorted by radius, so a range of radii of some cells is a few row groups of a few folders. ``store.upsert`` appends to the cells what it
writes to the table. An entry counts while its version is the event's latest; entries of replaced forms are passed over.

The search is exact: the triangle inequality tells which radii of a cell can hold a better row than the k-th found so far. On vectors
without any clusters that is all of them. With ``probes`` only that many cells are looked at, which is approximate; measure its recall.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import search
from tidemark.plans import store
from tidemark.session import local_rows

PIVOTS, CELLS = "pivots", "cells"
_ENTRY = (*store.KEYS, "offset", "version", "radius", "embedding", "cell")


def pivots(spark: SparkSession, path: str) -> list[list[float]] | None:
    """The index's pivots, a fixed small number of vectors, or None where the table has no index."""
    folder = f"{path}/{PIVOTS}"
    if not store.exists(spark, folder):
        return None
    return [list(r.vector) for r in spark.read.parquet(folder).orderBy("cell").collect()]


def _entries(rows: DataFrame, chosen: Sequence[Sequence[float]]) -> DataFrame:
    return search.assign_cells(rows, chosen).select(*_ENTRY)


def _append(entries: DataFrame, path: str, mode: str = "append", block_bytes: int | None = None) -> None:
    # Large cells become several files, small ones share a task.
    writer = entries.hint("rebalance", "cell").sortWithinPartitions("cell", "radius").write.mode(mode).partitionBy("cell")
    if block_bytes:
        writer = writer.option("parquet.block.size", block_bytes)
    writer.parquet(f"{path}/{CELLS}")


def create(spark: SparkSession, path: str, count: int = 16, block_bytes: int | None = None) -> None:
    """Index what the table holds. The pivots are written last: until then there is no index, and a repeated call starts over."""
    events = store.read(spark, path)
    if events is None:
        raise ValueError(f"no event table at {path}")
    if pivots(spark, path) is not None:
        raise ValueError(f"the table at {path} has an index")
    replaced = store._scan(spark, f"{path}/{store.REPLACEMENTS}")
    zero = F.lit(0).cast("long")
    if replaced is None:
        rows = events.withColumn("version", zero)
    else:
        versions = store.latest_replacements(replaced).select(*store.KEYS, "version")
        rows = events.join(versions, list(store.KEYS), "left").withColumn("version", F.coalesce("version", zero))
    chosen = search.choose_pivots(events, count)
    if not chosen:
        raise ValueError("no vector to take as a pivot")
    _append(_entries(rows, chosen), path, "overwrite", block_bytes)
    table = local_rows(spark, list(enumerate(chosen)), "cell int, vector array<double>")
    table.coalesce(1).write.parquet(f"{path}/{PIVOTS}")


def add(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Append the entries of rows with a ``version``; nothing where the table has no index or the rows no vectors."""
    if "embedding" in rows.columns and (chosen := pivots(spark, path)) is not None:
        _append(_entries(rows, chosen), path)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries that count: of every event the one of its latest version."""
    kinds = {"event_date": T.DateType(), "topic": T.StringType(), "partition": T.IntegerType(), "offset_block": T.LongType(), "cell": T.IntegerType()}
    folder = f"{path}/{CELLS}"
    typed = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in spark.read.parquet(folder).schema])
    stored = spark.read.schema(typed).parquet(folder)
    replaced = store._scan(spark, f"{path}/{store.REPLACEMENTS}")
    if replaced is None:
        return stored
    latest = replaced.groupBy("point_id").agg(F.max("version").alias("latest"))
    # Narrow rows of replaced events only.
    both = stored.join(latest, "point_id", "left")
    return both.filter(F.col("version") == F.coalesce("latest", F.lit(0).cast("long"))).drop("latest")


def find(spark: SparkSession, path: str, vector: Sequence[float], limit: int = 10, probes: int | None = None) -> DataFrame:
    """Coordinates and score of the ``limit`` closest events, from the cells alone."""
    chosen = pivots(spark, path)
    if chosen is None:
        raise ValueError(f"the table at {path} has no index")
    rows = search.pruned_top(entries(spark, path), chosen, vector, limit, probes)
    return rows.select(*store.KEYS, "offset", "score")


def search_table(
    spark: SparkSession, path: str, vector: Sequence[float], limit: int = 10, probes: int | None = None, max_results: int | None = None, value_cap: int = search.VALUE_CAP
) -> DataFrame:
    """The ``limit`` closest events as readers see them. Their rows are fetched from the table once they are known."""
    k, cut = search.clamp_limit(limit, max_results)
    found = find(spark, path, vector, k, probes).collect()  # k rows, the answer
    events = store.read(spark, path, *_span(found))
    if events is None:
        raise ValueError(f"no event table at {path}")
    best = local_rows(spark, [(r.point_id, r.score) for r in found], "point_id string, score double")
    near = [F.col(c).isin(sorted({r[c] for r in found})) for c in ("event_date", "topic", "partition", "offset_block", "offset")]
    for condition in near:
        events = events.filter(condition) if found else events.limit(0)
    rows = events.join(F.broadcast(best), "point_id")  # k rows
    rows = search.results(rows, value_cap, F.col("score")).orderBy(F.desc("score"), "event_id")
    return search.flagged(rows, max_results, cut)


def _span(found: list) -> tuple[int | None, int | None]:
    """First and last millisecond of the days of some rows."""
    from datetime import date

    if not found:
        return None, None
    days = [(r.event_date - date(1970, 1, 1)).days for r in found]
    return min(days) * 86_400_000, max(days) * 86_400_000
