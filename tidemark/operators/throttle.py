"""Token-bucket throttling of a table or a stream of calls.

A bucket of ``capacity`` tokens fills up evenly within ``period_ms``; each call takes one token or
is refused. Levels are kept in whole units of ``1 / period_ms`` token, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timeparts import floor_div
from tidemark.session import null_safe_join, written_once

MINUTE_MS = 60_000


class Bucket:
    """The level of one key's bucket. Time that runs backwards adds nothing."""

    __slots__ = ("capacity", "period", "level", "last")

    def __init__(self, capacity: int, period_ms: int, level: int | None = None, last: int | None = None):
        self.capacity, self.period = capacity, period_ms
        self.level = capacity * period_ms if level is None else level
        self.last = last

    def take(self, at_ms: int, calls: int = 1) -> int:
        """Admit up to ``calls`` calls at one moment and return how many were admitted."""
        if self.last is not None:
            self.level = min(self.capacity * self.period, self.level + max(0, at_ms - self.last) * self.capacity)
        self.last = at_ms if self.last is None else max(self.last, at_ms)
        admitted = min(calls, self.level // self.period)
        self.level -= admitted * self.period
        return admitted

    def retry_after_ms(self) -> float:
        return max(0, self.period - self.level) / self.capacity


def throttle(
    calls: DataFrame,
    key: str,
    order: Sequence[str],
    capacity: int,
    period_ms: int = MINUTE_MS,
    time: str = "timestamp_ms",
) -> DataFrame:
    """Add ``allowed`` and ``retry_after_sec`` to every call; capacity 0 allows everything.

    What a bucket does next depends on every earlier decision of its key, but only through the
    number of calls per millisecond. So calls are counted per (key, millisecond) first, and the
    sequential pass sees that timeline alone, streamed in time order and cut wherever the key
    stayed idle long enough for the bucket to be full again. The verdicts are joined back to the
    calls, which therefore stay spread out even when one key holds a third of them.

    Calls without a key share one bucket. A call without a time cannot be metered: it is refused, with no time to wait.
    """
    if capacity <= 0:
        return calls.withColumns({"allowed": F.lit(True), "retry_after_sec": F.lit(0.0)})
    timeless = calls.filter(F.col(time).isNull()).withColumns({"allowed": F.lit(False), "retry_after_sec": F.lit(None).cast("double")})
    calls = calls.filter(F.col(time).isNotNull())
    slots = calls.groupBy(key, time).agg(F.count(F.lit(1)).alias("_n"))
    bin_ = floor_div(F.col(time), period_ms)
    bins = slots.select(key, bin_.alias("_bin")).distinct()
    along = Window.partitionBy(key).orderBy("_bin")
    # A whole empty bin between two active ones means the bucket has filled up.
    fresh = F.coalesce(F.col("_bin") - F.lag("_bin").over(along) > 1, F.lit(True)).cast("int")
    spells = bins.withColumn("_fresh", fresh).withColumn("_spell", F.sum("_fresh").over(along)).drop("_fresh")
    timeline = null_safe_join(slots.withColumn("_bin", bin_), spells, [key, "_bin"]).select(key, "_spell", time, "_n")
    # Used twice below, and the one step that cannot be split within a busy key: run it once.
    verdicts = written_once(_run(timeline, key, time, capacity, period_ms), "verdicts")
    # Only slots admitted in part need an order among their calls, and at most `capacity` of them pass.
    within = Window.partitionBy(key, time).orderBy(*order)
    part = null_safe_join(calls, verdicts.filter((F.col("_ok") > 0) & (F.col("_ok") < F.col("_n"))), [key, time])
    first = part.withColumn("_r", F.row_number().over(within)).filter(F.col("_r") <= capacity)
    cut = first.filter(F.col("_r") == F.col("_ok")).select(key, time, F.struct(*order).alias("_cut"))
    judged = null_safe_join(calls, null_safe_join(verdicts, cut, [key, time], "left"), [key, time])
    allowed = (F.col("_ok") == F.col("_n")) | F.coalesce(F.struct(*order) <= F.col("_cut"), F.lit(False))
    return judged.withColumns(
        {"allowed": allowed, "retry_after_sec": F.when(allowed, F.lit(0.0)).otherwise(F.col("_retry_ms") / F.lit(1000.0))}
    ).drop("_n", "_ok", "_retry_ms", "_cut").unionByName(timeless)


def _run(timeline: DataFrame, key: str, time: str, capacity: int, period_ms: int) -> DataFrame:
    schema = T.StructType([timeline.schema[key], timeline.schema[time]])
    schema = schema.add("_n", "long").add("_ok", "long").add("_retry_ms", "double")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, bucket = None, None
        for batch in batches:
            admitted, retry = np.empty(len(batch), np.int64), np.empty(len(batch))
            rows = zip(batch[key].tolist(), batch["_spell"].tolist(), batch[time].tolist(), batch["_n"].tolist(), strict=True)
            for i, (name, spell, at, n) in enumerate(rows):
                if owner != (name, spell):
                    owner, bucket = (name, spell), Bucket(capacity, period_ms)
                admitted[i] = bucket.take(at, n)
                retry[i] = bucket.retry_after_ms()
            yield batch[[key, time, "_n"]].assign(_ok=admitted, _retry_ms=retry)

    ordered = timeline.repartition(key, "_spell").sortWithinPartitions(key, "_spell", time)
    return ordered.mapInPandas(scan, schema)
