"""Instants. Text without a zone is read as UTC; sessions are expected to run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: Column, default: Column | None = None) -> Column:
    """ISO text to a timestamp; null or "" to the default; unreadable text to null."""
    blank = text.isNull() | (F.trim(text) == "")
    read = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
    return F.when(blank, default if default is not None else F.lit(None).cast("timestamp")).otherwise(read)


def too_late(at: Column, now: Column, minutes: int = 5) -> Column:
    """Whether an instant is further ahead than clocks may differ."""
    return at > now + F.make_interval(mins=F.lit(minutes))


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def day(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")
