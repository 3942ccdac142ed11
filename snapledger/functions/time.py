"""Naive timestamps, independent of the session's time zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(value: datetime | Column) -> Column:
    """A naive timestamp literal or column."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def hours_between(start: Column, end: Column) -> Column:
    """Hours from one naive timestamp to another, by calendar arithmetic."""
    gap = end - start
    days = F.extract(F.lit("DAY"), gap).cast("bigint")  # an int holds the seconds of 68 years only
    seconds = (
        days * 86400 + F.extract(F.lit("HOUR"), gap) * 3600
        + F.extract(F.lit("MINUTE"), gap) * 60 + F.floor(F.extract(F.lit("SECOND"), gap))
    )
    return F.round(seconds / F.lit(3600.0), 6)
