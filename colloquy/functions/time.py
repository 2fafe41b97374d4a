"""Column functions over timestamps; the session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def parse_iso(ts: Column) -> Column:
    """ISO-8601 text as a timestamp; null if it does not parse."""
    return F.try_to_timestamp(ts)


def local(ts: Column, offset_hours: int = 0) -> Column:
    """ts seen at a fixed whole-hour offset from UTC."""
    return ts + F.make_interval(hours=F.lit(offset_hours))


def hour(ts: Column) -> Column:
    return F.hour(ts)


def day(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
