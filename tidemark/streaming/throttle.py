"""The token bucket on a stream: one small state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.throttle import MINUTE_MS, Bucket

STATE = "level long, last long"


def throttle_stream(
    calls: DataFrame, key: str, capacity: int, period_ms: int = MINUTE_MS, time: str = "timestamp_ms", order: str = "offset"
) -> DataFrame:
    """Add ``allowed`` and ``retry_after_sec``. What one trigger reads bounds what a key holds at once.

    A late call adds no tokens and does not move the clock back.
    """
    schema = T.StructType(list(calls.schema.fields)).add("allowed", "boolean").add("retry_after_sec", "double")

    def decide(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([time, order], kind="stable")
        level, last = state.get if state.exists else (None, None)
        bucket = Bucket(capacity, period_ms, level, last)
        allowed, retry = [], []
        for at in rows[time].tolist():
            ok = bucket.take(int(at)) == 1
            allowed.append(ok)
            retry.append(0.0 if ok else bucket.retry_after_ms() / 1000.0)
        state.update((bucket.level, bucket.last))
        yield rows.assign(allowed=allowed, retry_after_sec=retry)

    return calls.groupBy(key).applyInPandasWithState(decide, schema, STATE, "append", GroupStateTimeout.NoTimeout)
