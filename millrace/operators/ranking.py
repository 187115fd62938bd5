"""One row per key, and ordered reports.

`row_number() = 1` is planned with a group limit before the shuffle: each map task
sends at most one row per key, so a hot key never travels as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; add tie-breaks to make it unique."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def newest_per_key(df: DataFrame, keys: Sequence[str], time: str, tie_break: Sequence[Column] = ()) -> DataFrame:
    """The newest row of each key, as a merge source needs it."""
    return first_per_key(df, keys, [F.col(time).desc(), *tie_break])


def sorted_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys in order, one row each, sorted across the cluster by range."""
    return df.select(*keys).distinct().orderBy(*keys)
