"""File listings as tables, so that a change of files is a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, size, mtime) of every file below folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(folder)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    )
