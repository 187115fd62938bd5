"""The sales tables: sample, silver, daily summary, freshness, incremental load."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators.aggregate import daily_summary, freshness
from millrace.operators.merge import incremental_window, upsert_newer
from millrace.operators.ranking import newest_per_key
from millrace.operators.transform import on_day, present_and_positive
from millrace.schemas import SILVER_SALES

# Rows to try the pipeline with (order, customer, product, quantity, price, revenue, status).
SAMPLE_SALES = (
    ("S-1", "ada", "lamp", 4, 12.50, 50.00, "completed"),
    ("S-2", "bo", "desk", 1, 180.00, 180.00, "completed"),
    ("S-3", "ada", "chair", 3, 41.25, 123.75, "pending"),
)
# What an update of a silver row takes from its source: all but its key and when it was first seen.
SILVER_UPDATES = tuple(name for name in SILVER_SALES.names if name not in ("order_id", "processed_at"))


def sample_sales(spark: SparkSession, as_of: Column) -> DataFrame:
    """The sample bronze table as of a moment."""
    named = spark.createDataFrame(
        [tuple(row) for row in SAMPLE_SALES],
        "order_id string, customer_id string, product_id string, quantity int, "
        "unit_price double, revenue double, status string",
    )
    return named.select(
        "order_id",
        "customer_id",
        "product_id",
        as_of.cast("date").alias("order_date"),
        "quantity",
        F.col("unit_price").cast("decimal(10,2)").alias("unit_price"),
        F.col("revenue").cast("decimal(12,2)").alias("revenue"),
        "status",
        as_of.alias("processed_at"),
    )


def to_silver(bronze: DataFrame, as_of: Column) -> DataFrame:
    """Bronze to silver: known order and customer, positive revenue, dates, upper-case status."""
    kept = present_and_positive(bronze, ["order_id", "customer_id"], ["revenue"])
    return kept.select(
        *[
            {
                "order_date": F.col("order_date").cast("date").alias("order_date"),
                "status": F.upper("status").alias("status"),
            }.get(name, F.col(name))
            for name in bronze.columns
        ],
        as_of.alias("updated_at"),
    )


def daily_sales(sales: DataFrame, as_of: Column, day: str | None = None, done: str = "COMPLETED") -> DataFrame:
    """The daily summary, of one day if a day is given. Reads silver, so statuses are upper-case."""
    return daily_summary(on_day(sales, "order_date", day) if day else sales, as_of, done)


def audit_freshness(audit: DataFrame, as_of: Column, max_hours: str | int, expected: DataFrame | None = None) -> DataFrame:
    """Freshness of audited tables; the limit may come as text, as task parameters do."""
    return freshness(audit, as_of, int(max_hours), expected)


def incremental_load(
    silver: DataFrame, bronze: DataFrame, as_of: Column, key: str = "order_id", **options
) -> DataFrame:
    """Bronze rows since the last load, newest per key, cleansed and merged where newer."""
    fresh = incremental_window(bronze, silver, "processed_at", "updated_at")
    newest = newest_per_key(fresh, [key], "processed_at", [F.col(c).desc() for c in bronze.columns if c != key])
    updates = [c for c in SILVER_UPDATES if c in silver.columns]
    return upsert_newer(silver, to_silver(newest, as_of), [key], "updated_at", update=updates, unique=True, **options)


@dataclass(frozen=True)
class SalesRun:
    bronze: DataFrame
    silver: DataFrame
    daily: DataFrame


def sales_run(bronze: DataFrame, as_of: Column, done: str = "COMPLETED") -> SalesRun:
    """Bronze to silver to daily summary, as one lazy plan."""
    silver = to_silver(bronze, as_of)
    return SalesRun(bronze, silver, daily_sales(silver, as_of, done=done))
