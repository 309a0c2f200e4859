"""Local calendar days and offset timestamps.  Sessions run in UTC; local time is always asked for by name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallybook import fixed_values as V


def local_day(ts: Column, zone: str = V.LOCAL_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def offset_to_utc(text: Column) -> Column:
    """'2026-10-05T18:00:00-05:00' as a timestamp; a date alone is its midnight."""
    return F.to_timestamp(text)


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")
