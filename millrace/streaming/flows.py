"""File and table sources, append flows and triggers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType


def file_arrivals(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    fmt: str = "parquet",
    glob: str | None = None,
    files_per_batch: int | None = None,
    **options: str,
) -> DataFrame:
    """New files below a folder, sub-folders included, as a stream."""
    reader = spark.readStream.format(fmt).schema(schema).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.options(**options).load(folder)


def document_arrivals(spark: SparkSession, folder: str, glob: str, files_per_batch: int | None = None) -> DataFrame:
    """(path, content) of new documents, whole, as a stream."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.text(folder, wholetext=True)
    return stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def table_updates(spark: SparkSession, name: str) -> DataFrame:
    """New rows of a named table as a stream."""
    return spark.readStream.table(name)


def trigger(writer: DataStreamWriter, interval: str | None) -> DataStreamWriter:
    """Everything available and stop, or a batch per interval for a load that stays on."""
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def append_flow(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Row-wise flow into a parquet folder; the file sink commits each batch once."""
    writer = transform(stream).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", target).option("checkpointLocation", checkpoint)
    return trigger(writer, interval).start()
