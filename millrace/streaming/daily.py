"""The daily sales summary kept up to date by a stream of sales."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DecimalType, DoubleType, LongType, StructField, StructType

from millrace.operators.partials import SUMS, added, daily_partials, summary_of
from millrace.sources.staging import stage
from millrace.streaming import ledger
from millrace.streaming.flows import trigger


def partials_schema(sales: StructType) -> StructType:
    """Types that hold the sums of any number of batches: decimals as wide as they go, counts as longs."""
    revenue = sales["revenue"].dataType
    wide = DecimalType(38, revenue.scale) if isinstance(revenue, DecimalType) else DoubleType()
    kinds = {c: wide if c == "total_revenue" else LongType() for c in SUMS}
    return StructType([sales["order_date"], *(StructField(c, kinds[c]) for c in SUMS)])


def daily_flow(
    stream: DataFrame,
    prepare: Callable[[DataFrame], DataFrame],
    sales_schema: StructType,
    root: str,
    checkpoint: str,
    done: str = "COMPLETED",
    interval: str | None = None,
) -> StreamingQuery:
    """Add each micro-batch of sales to the sums of its days.

    prepare makes sales of a batch, row by row. Beside the sums, one row a day, lies a
    table of the (day, customer) pairs that batches were first to see, so that customers
    are counted once; a batch reads the pairs of earlier ones and adds its new ones. A
    repeated batch reads what lies below it and overwrites its own output.
    """
    sums_schema = partials_schema(sales_schema)
    pair_schema = StructType([sales_schema[c] for c in ("order_date", "customer_id")])

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sales = stage(prepare(batch), "sales")
        pairs = sales.select(*pair_schema.names).filter("customer_id IS NOT NULL").distinct()
        earlier = ledger.batches(spark, f"{root}/customers", pair_schema, batch_id).drop("batch_id")
        same = pairs["order_date"].eqNullSafe(earlier["order_date"]) & (pairs["customer_id"] == earlier["customer_id"])
        new = stage(pairs.join(earlier, same, "left_anti"), "customers")
        ledger.write(new, f"{root}/customers", batch_id)
        part = daily_partials(sales, new, done)
        ledger.write(added(_before(spark, root, sums_schema, batch_id), part), f"{root}/sums", batch_id)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return trigger(writer, interval).start()


def _before(spark: SparkSession, root: str, schema: StructType, batch_id: int | None) -> DataFrame:
    last = ledger.newest(spark, f"{root}/sums", batch_id)
    if last is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(ledger.batch_path(f"{root}/sums", last))


def daily_so_far(spark: SparkSession, sales_schema: StructType, root: str, as_of: Column) -> DataFrame:
    """The daily summary of all whole batches."""
    return summary_of(_before(spark, root, partials_schema(sales_schema), None), as_of)
