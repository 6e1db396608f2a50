"""Durations and exact positions in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds per unit of a duration text such as '30 days'.
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}


def micros_in(duration: str) -> int:
    """Microseconds in a text like '30 days' or '1 hour'."""
    amount, unit = duration.split()
    unit = unit.lower().rstrip("s")
    if unit not in UNIT_SECONDS:
        raise ValueError(f"unknown unit in duration {duration!r}")
    return round(float(amount) * UNIT_SECONDS[unit] * 1_000_000)


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a date or timestamp column, without any time-zone shift of zone-free values."""
    kind = df.schema[column].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column))
    if kind in ("timestamp", "date"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    raise TypeError(f"{column!r} is {kind}, not a date or timestamp")


def shifted(time: Column, by_micros: Column) -> Column:
    """A timestamp moved by some microseconds."""
    seconds = by_micros.cast("decimal(38,6)") / F.lit(1_000_000).cast("decimal(10,0)")
    return time + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
