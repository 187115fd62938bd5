"""Grouped and global aggregations. All combine on the map side before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.temporal import or_epoch, whole_hours


def daily_summary(sales: DataFrame, as_of: Column, done: str = "COMPLETED") -> DataFrame:
    """Per order_date: orders, revenue, quantity, customers, mean order value, orders done.

    Revenue is summed in its own type: decimals exactly (and, up to decimal(8,s), as
    longs), doubles in whatever order the rows come.
    """
    revenue = F.col("revenue")
    return sales.groupBy("order_date").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum(revenue).alias("total_revenue"),
        F.sum("quantity").alias("total_quantity"),
        F.count_distinct("customer_id").alias("unique_customers"),
        (F.sum(revenue).cast("double") / F.count(revenue)).alias("avg_order_value"),
        F.count_if(F.col("status") == done).alias("completed_orders"),
        F.first(as_of).alias("processed_at"),
    )


def latest(df: DataFrame, column: str, fallback: Column | None = None) -> DataFrame:
    """One row: the greatest value of a column, or the fallback when there is none."""
    kind = df.schema[column].dataType.simpleString()
    value = F.max(column)
    return df.agg((F.coalesce(value, fallback) if fallback is not None else or_epoch(value, kind)).alias(column))


def freshness(
    audit: DataFrame,
    as_of: Column,
    max_hours: int,
    expected: DataFrame | None = None,
    table: str = "table_name",
    updated: str = "last_update_time",
) -> DataFrame:
    """Age in whole hours of each table's latest update, as FRESH, STALE or NO_DATA.

    Tables listed in expected are reported even when the audit holds no row of them.
    """
    newest = audit.groupBy(table).agg(F.max(updated).alias(updated))
    if expected is not None:
        newest = expected.select(table).distinct().join(newest, table, "left")
    hours = whole_hours(F.col(updated), as_of)
    return newest.select(
        table,
        updated,
        as_of.alias("check_time"),
        hours.alias("hours_since_update"),
        F.when(hours > max_hours, "STALE").when(hours.isNull(), "NO_DATA").otherwise("FRESH").alias("freshness_status"),
    )


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def row_count(df: DataFrame, name: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def quality_check(df: DataFrame, name: str, measure: Column, limit: float, as_of: Column) -> DataFrame:
    """One row: the check's name, time, measured value, limit and PASS or FAIL."""
    return df.agg(measure.alias("measured_value")).select(
        as_of.alias("check_timestamp"),
        F.lit(name).alias("check_name"),
        "measured_value",
        F.lit(float(limit)).alias("threshold_value"),
        F.when(F.col("measured_value") <= F.lit(limit), "PASS").otherwise("FAIL").alias("quality_status"),
    )
