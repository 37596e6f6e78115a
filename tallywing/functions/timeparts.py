"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_timestamp(text: Column) -> Column:
    """ISO-8601 text as TIMESTAMP_NTZ in UTC; null where it does not parse.

    Going through TIMESTAMP honours explicit offsets (the session runs in UTC).
    """
    return text.try_cast("timestamp").cast("timestamp_ntz")


def weekday_sunday0(ts: Column) -> Column:
    return F.dayofweek(ts) - 1


def week_label(ts: Column) -> Column:
    """``yyyy-Www`` with Monday-first weeks; days before the first Monday are W00."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("string")
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(week, 2, "0"))


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes to two decimals, rounded half up on whole milliseconds."""
    ms = F.timestamp_diff("MILLISECOND", start, end)
    return F.floor((ms * 100 + 30000) / 60000) / 100
