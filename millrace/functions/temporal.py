"""Times. The present is a parameter; the clock is read only by callers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

EPOCH = "1970-01-01 00:00:00"


def at(moment: str | datetime, kind: str = "timestamp_ntz") -> Column:
    """A fixed time as a literal of the given timestamp type."""
    return F.lit(str(moment)).cast(kind)


def whole_hours(start: Column, end: Column) -> Column:
    """Completed hours from start to end."""
    return F.timestamp_diff("HOUR", start, end)


def or_epoch(moment: Column, kind: str = "timestamp_ntz") -> Column:
    return F.coalesce(moment, at(EPOCH, kind))
