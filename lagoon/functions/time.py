"""Ticks and calendar buckets of time columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


def micros(df: DataFrame, col: str) -> Column:
    """A time column as a long: microseconds since the epoch for timestamps (no session zone involved for zoneless ones), itself for numbers."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.TimestampNTZType):
        since = f"CAST(`{col}` - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND)"
        return F.expr(f"CAST(CAST({since} AS DECIMAL(20, 6)) * 1000000 AS BIGINT)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("long") * MICROS["d"]
    return F.col(col).cast("long")


def span(text: str | int) -> int:
    """'5m' as microseconds; a number stays."""
    if isinstance(text, int):
        return text
    digits = text.rstrip("abcdefghijklmnopqrstuvwxyz")
    return int(digits or 1) * MICROS[text[len(digits) :]]


def floor_div(x: Column, width: int) -> Column:
    """Bucket of a long, rounded down for negative values too."""
    x = x.cast("long")
    return x if width == 1 else F.call_function("div", x - F.pmod(x, F.lit(width)), F.lit(width))


def week_bucket(ts: Column, minutes: int = 5) -> Column:
    """Bucket of the week, Monday first; the minute before the first full step of a day joins its bucket 0."""
    per_day = 24 * 60 // minutes
    minute_of_day = F.hour(ts) * 60 + F.minute(ts)
    return (F.weekday(ts) * per_day + F.floor(F.greatest(minute_of_day - 1, F.lit(0)) / minutes)).cast("long")


def day_bucket(ts: Column, minutes: int = 60) -> Column:
    return F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes).cast("long")
