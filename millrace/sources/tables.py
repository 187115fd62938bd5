"""Table scans and literal rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scan(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table or view by name."""
    return spark.table(name)


def scan_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder that holds `<name>.parquet` per table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_identifier(spark: SparkSession, *parts: str) -> DataFrame:
    """A table whose (catalog, schema, table) parts are parameters, bound and never spliced."""
    names = {f"p{i}": part for i, part in enumerate(parts)}
    marker = " || '.' || ".join(f":{name}" for name in names)
    return spark.sql(f"SELECT * FROM IDENTIFIER({marker})", args=names)


def full_name(*parts: str) -> str:
    """catalog.schema.table; every part must be given."""
    missing = [i for i, part in enumerate(parts) if not part]
    if missing:
        raise ValueError(f"empty name part at position {missing[0]}")
    return ".".join(parts)


def rows(spark: SparkSession, values: Iterable[Sequence], schema: StructType | str) -> DataFrame:
    """Literal rows with an explicit schema."""
    return spark.createDataFrame(list(values), schema)


def scan_or_sample(spark: SparkSession, name: str, sample: DataFrame, save: bool = True) -> DataFrame:
    """The named table, or the sample when there is no such table.

    Only a missing table falls back: any other read error is raised.
    """
    if spark.catalog.tableExists(name):
        return spark.table(name)
    if save:
        sample.write.mode("overwrite").saveAsTable(name)
        return spark.table(name)
    return sample
