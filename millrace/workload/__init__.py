"""Queries over the test tables, each with its SQL equivalent.

A module of this package holds QUERIES (name -> function of session and folder) and SQL
(name -> statement). Every query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.sources.tables import scan_parquet


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return scan_parquet(spark, folder, name)


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, the types both engines print alike."""
    def shown(field):
        kind = field.dataType.simpleString()
        if kind.startswith("decimal"):
            return F.col(field.name).cast("double").alias(field.name)
        if kind == "date":
            return F.col(field.name).cast("string").alias(field.name)
        return F.col(field.name)

    return df.select(*[shown(field) for field in df.schema.fields])
