"""Projections, filters and set operations on data tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def project(df: DataFrame, columns: Mapping[str, str], types: Mapping[str, str] | None = None) -> DataFrame:
    """Select and rename (new name -> old name), casting the new names listed in types."""
    types = types or {}
    return df.select(
        *[
            (F.col(old).cast(types[new]) if new in types else F.col(old)).alias(new)
            for new, old in columns.items()
        ]
    )


def with_lineage(df: DataFrame, task_key: str, as_of: Column) -> DataFrame:
    """Add when, and by which task, a row was ingested."""
    return df.withColumns({"ingestion_timestamp": as_of, "task_key": F.lit(task_key)})


def full_name(*parts: Column) -> Column:
    """Parts joined by a space; NULL if any part is NULL."""
    spaced = [x for part in parts for x in (F.lit(" "), part)][1:]
    return F.concat(*spaced)


def equals(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def present_and_positive(df: DataFrame, required: Sequence[str], positive: Sequence[str]) -> DataFrame:
    """Rows whose required columns are not NULL and whose positive columns exceed zero."""
    for name in required:
        df = df.filter(F.col(name).isNotNull())
    for name in positive:
        df = df.filter(F.col(name) > 0)
    return df


def on_day(df: DataFrame, column: str, day: str) -> DataFrame:
    """Rows of one day, as a half-open range so that the filter reaches the scan."""
    kind = df.schema[column].dataType.simpleString()
    if kind == "date":
        return df.filter(F.col(column) == F.lit(day).cast("date"))
    start = F.lit(day).cast("date")
    return df.filter(
        (F.col(column) >= start.cast(kind)) & (F.col(column) < F.date_add(start, 1).cast(kind))
    )


def newer_than(df: DataFrame, column: str, watermark) -> DataFrame:
    """Rows strictly after the watermark."""
    kind = df.schema[column].dataType.simpleString()
    moment = watermark if isinstance(watermark, Column) else F.lit(str(watermark))
    return df.filter(F.col(column) > moment.cast(kind))


def classify(value: Column, limit, passed: str = "PASS", failed: str = "FAIL") -> Column:
    """passed while the value does not exceed the limit."""
    return F.when(value <= F.lit(limit), passed).otherwise(failed)


def union_all(*frames: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Rows of all frames by column name; with allow_missing absent columns read NULL."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=allow_missing)
    return result


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left, with repeats, that right does not use up."""
    return left.exceptAll(right)


def preview(df: DataFrame, columns: Sequence[str], order: Sequence, n: int = 5) -> DataFrame:
    """The first n rows of the chosen columns in a stated order."""
    return df.select(*columns).orderBy(*order).limit(n)
