"""The ledger of a folder of batches: one small row for each batch whose output is whole.

A row is written after all of its batch's output, so readers that go by the ledger never
see half a batch, and a batch that comes again after a failure is known by its number.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

SCHEMA = "batch_id long, rows_read long, rows_kept long, rows_written long"


def _path(root: str) -> str:
    return f"{root}/_ledger"


def record(spark: SparkSession, root: str, batch_id: int, read: int | None = None, kept: int | None = None, written: int | None = None) -> None:
    """Note that a batch is whole, with its counts if they were taken; noting it again changes nothing."""
    row = spark.createDataFrame([(batch_id, read, kept, written)], SCHEMA).drop("batch_id").coalesce(1)
    row.write.mode("overwrite").parquet(f"{_path(root)}/batch_id={batch_id}")


def finished(spark: SparkSession, root: str) -> DataFrame:
    """(batch_id, rows_read, rows_kept, rows_written) of the batches that are whole."""
    try:
        return spark.read.schema(SCHEMA).parquet(_path(root))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def is_finished(spark: SparkSession, root: str, batch_id: int) -> bool:
    return not finished(spark, root).filter(F.col("batch_id") == batch_id).isEmpty()


def newest(spark: SparkSession, root: str, below: int | None = None) -> int | None:
    """The newest whole batch, or the newest below a batch; None if there is none."""
    ledger = finished(spark, root)
    if below is not None:
        ledger = ledger.filter(F.col("batch_id") < below)
    return ledger.agg(F.max("batch_id")).first()[0]


def batch_path(root: str, batch_id: int) -> str:
    return f"{root}/batch_id={batch_id}"


def write(rows: DataFrame, root: str, batch_id: int) -> None:
    """A batch's whole output, then its entry in the ledger."""
    rows.write.mode("overwrite").parquet(batch_path(root, batch_id))
    record(rows.sparkSession, root, batch_id)


def batches(spark: SparkSession, root: str, schema: StructType, below: int | None = None) -> DataFrame:
    """The rows of all whole batches, or of those below a batch, with their batch_id."""
    full = StructType([*schema.fields, StructField("batch_id", LongType())])
    last = newest(spark, root, below)
    if last is None:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(root).filter(F.col("batch_id") <= last)
