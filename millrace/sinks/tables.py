"""Writes to catalog tables and folders."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from millrace.schemas import CONTROL, ID_MAP
from millrace.sources.staging import stage

# Defaults of the control tables.
CONTROL_DEFAULTS = {
    "disabled": "false",
    "created_timestamp": "current_timestamp()",
    "updated_timestamp": "current_timestamp()",
}
ID_MAP_DEFAULTS = {
    "created_timestamp": "current_timestamp()",
    "updated_timestamp": "current_timestamp()",
}
WRITE_MODES = ("overwrite", "append", "ignore", "error")


def create_if_missing(
    spark: SparkSession,
    name: str,
    schema: StructType,
    defaults: Mapping[str, str] | None = None,
    provider: str = "parquet",
    partition_by: tuple[str, ...] = (),
) -> None:
    """Create the table unless it exists; inserts that leave a column out take its default."""
    defaults = defaults or {}
    columns = ", ".join(
        f"`{field.name}` {field.dataType.simpleString()}"
        + (f" DEFAULT {defaults[field.name]}" if field.name in defaults else "")
        for field in schema.fields
    )
    partitions = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {provider}{partitions}")


def create_control_table(spark: SparkSession, name: str) -> None:
    create_if_missing(spark, name, CONTROL, CONTROL_DEFAULTS)


def create_id_map_table(spark: SparkSession, name: str) -> None:
    create_if_missing(spark, name, ID_MAP, ID_MAP_DEFAULTS)


def replace_table(df: DataFrame, name: str) -> None:
    """Create or replace a table from a query that does not read it."""
    df.write.mode("overwrite").saveAsTable(name)


def create_table_as(df: DataFrame, name: str) -> None:
    """Create a table from a query only if it is missing."""
    df.write.mode("ignore").saveAsTable(name)


def replace_own_source(df: DataFrame, name: str) -> None:
    """Replace a table by a query that reads it: staged first, then swapped in.

    The staged copy is complete before the target is touched, so a failed swap can
    be repeated from it.
    """
    overwrite(stage(df, "replace"), name)


def overwrite(staged: DataFrame, name: str) -> None:
    """Replace the rows of a table by those of a staged one."""
    staged.write.mode("overwrite").insertInto(name, overwrite=True)


def write_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    """Write with a mode parameter; appends take new columns in (old rows read NULL)."""
    if mode not in WRITE_MODES:
        raise ValueError(f"unknown write mode {mode!r}, expected one of {WRITE_MODES}")
    spark = df.sparkSession
    if mode == "append" and spark.catalog.tableExists(name):
        known = {c.lower() for c in spark.table(name).columns}
        added = [f for f in df.schema.fields if f.name.lower() not in known]
        if added:
            spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
            spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({spec})")
        columns = spark.table(name).schema.fields
        have = {c.lower() for c in df.columns}
        df.select(
            *[
                F.col(f.name).cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name)
                for f in columns
            ]
        ).write.insertInto(name)
        return
    df.write.mode(mode).saveAsTable(name)


def append_folder(df: DataFrame, path: str) -> DataFrame:
    """Append to a parquet folder and read it back with the schemas merged."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.option("mergeSchema", "true").parquet(path)


def temp_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def write_verified(
    source: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    write: Callable[[DataFrame], object],
    count_target: Callable[[], int],
    mode: str = "overwrite",
    exists: bool = False,
) -> dict[str, int]:
    """Write transform(source) and report rows read, kept, in the target before and after.

    Rows read and kept are observed while the write runs; the target is counted after it,
    and before it as well if rows are appended. A write that mode `ignore` skips, as the
    target exists, reads and keeps no rows.
    """
    before = count_target() if exists and mode in ("append", "ignore") else 0
    if exists and mode == "ignore":
        return {"rows_read": 0, "rows_kept": 0, "rows_before": before, "rows_in_target": before}
    read, kept = Observation("rows_read"), Observation("rows_kept")
    observed = source.observe(read, F.count(F.lit(1)).alias("n"))
    result = transform(observed).observe(kept, F.count(F.lit(1)).alias("n"))
    write(result)
    counts = {"rows_read": read.get["n"], "rows_kept": kept.get["n"]}
    return counts | {"rows_before": before, "rows_in_target": count_target()}
