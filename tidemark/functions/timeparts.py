"""Epoch milliseconds and UTC days, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms_ntz(ts: Column) -> Column:
    """Epoch milliseconds of a zone-less timestamp read as UTC."""
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def ntz_of_ms(ms: int) -> Column:
    """A zone-less timestamp literal for epoch milliseconds."""
    return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {int(ms)} / 1000.0BD)")


def floor_div(value: Column, by: int) -> Column:
    """Whole-number division rounding down, exact over the whole BIGINT range."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def utc_day(ms: Column) -> Column:
    """The UTC calendar day of epoch milliseconds, whatever the session zone is."""
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ms, 86_400_000).cast("int"))
