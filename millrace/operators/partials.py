"""Daily summaries kept as sums that can be added up, instead of computed anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# One row a day; unique_customers counts customers that no earlier part had on that day.
SUMS = ("total_orders", "total_revenue", "priced_orders", "total_quantity", "unique_customers", "completed_orders")


def daily_partials(sales: DataFrame, new_customers: DataFrame, done: str = "COMPLETED") -> DataFrame:
    """(order_date, SUMS) of some sales; new_customers are the (order_date, customer_id) first seen in them."""
    revenue = F.col("revenue")
    sums = sales.groupBy("order_date").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum(revenue).alias("total_revenue"),
        F.count(revenue).alias("priced_orders"),
        F.sum("quantity").alias("total_quantity"),
        F.count_if(F.col("status") == done).alias("completed_orders"),
    )
    customers = new_customers.groupBy("order_date").agg(F.count("customer_id").alias("unique_customers"))
    same = sums["order_date"].eqNullSafe(customers["order_date"])
    joined = sums.join(customers, same, "left").drop(customers["order_date"])
    return joined.select("order_date", *(F.coalesce(c, F.lit(0)).alias(c) if c == "unique_customers" else F.col(c) for c in SUMS))


def added(one: DataFrame, other: DataFrame) -> DataFrame:
    """Partials of two parts as those of both; sums keep the types of the first."""
    both = one.unionByName(other)
    return both.groupBy("order_date").agg(*(F.sum(c).cast(one.schema[c].dataType).alias(c) for c in SUMS))


def summary_of(partials: DataFrame, as_of: Column) -> DataFrame:
    """The daily summary that daily_summary would compute from all sales."""
    return partials.select(
        "order_date", "total_orders", "total_revenue", "total_quantity", "unique_customers",
        (F.col("total_revenue").cast("double") / F.col("priced_orders")).alias("avg_order_value"),
        "completed_orders", as_of.alias("processed_at"),
    )
