"""Merges into large partitioned tables: only the partitions a merge may change are read and rewritten."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from millrace.operators.merge import merge, update_where
from millrace.sources.staging import stage


@dataclass(frozen=True)
class Rewritten:
    """Numbers of partitions: those a merge could change, those with rows that were written, those left without rows."""

    touched: int
    written: int
    emptied: int


def merge_partitions(
    spark: SparkSession,
    path: str,
    schema: StructType,
    source: DataFrame,
    keys: Sequence[str],
    partition_by: Sequence[str],
    **merge_options,
) -> Rewritten:
    """Merge source into the parquet table at path, partition by partition.

    The partition columns belong to the keys, so no row moves between partitions. Touched
    are exactly the partitions of the source's rows, the one of NULL among them if it has
    such rows; with a scoped delete also those that hold rows of the source's scopes, and
    with delete="all" every one. The scan reads touched partitions alone. The result is
    staged, partitions with rows are overwritten, and those left without rows are emptied.
    Merging the same source again changes nothing, so a failed run is simply repeated.

    The driver holds the touched partitions' values, as it does for any scan of the table.
    """
    by = list(partition_by)
    if not set(by) <= set(keys):
        raise ValueError("partition columns must be part of the merge keys")
    # Read several times below, and better planned once its size is known.
    source = stage(source, "source")
    table = spark.read.schema(schema).parquet(path)
    touched = _values(_touched(table, source, by, merge_options.get("delete")))
    here = table.filter(_in(touched, by, schema))
    before = here.select(*by, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).distinct().collect()
    staged = stage(merge(here, source, keys, staged=True, **merge_options).select(*schema.names), "partitions")
    after = _values(staged.select(*by))
    # Rebalancing keeps files of even size: it splits large partitions and merges small ones.
    staged.hint("rebalance", *by).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*by).parquet(path)
    emptied = sorted({row["folder"] for row in before if tuple(row[c] for c in by) not in after})
    rest = StructType([f for f in schema.fields if f.name not in by])
    for folder in emptied:
        spark.createDataFrame([], rest).write.mode("overwrite").parquet(unquote(folder))
    return Rewritten(len(touched), len(after), len(emptied))


def update_partitions(
    spark: SparkSession,
    path: str,
    schema: StructType,
    condition: Column,
    assignments: Mapping[str, Column],
    partition_by: Sequence[str],
) -> Rewritten:
    """Set columns of the rows a condition selects in the parquet table at path.

    Only partitions that hold such rows are rewritten, staged first; partition columns
    cannot be set, as rows do not move. Updating again must change nothing for a failed
    run to be repeated, which is up to the assignments.
    """
    by = list(partition_by)
    if set(by) & set(assignments):
        raise ValueError("partition columns cannot be set")
    table = spark.read.schema(schema).parquet(path)
    touched = _values(table.filter(condition).select(*by))
    here = table.filter(_in(touched, by, schema))
    staged = stage(update_where(here, condition, assignments).select(*schema.names), "partitions")
    staged.hint("rebalance", *by).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*by).parquet(path)
    return Rewritten(len(touched), len(touched), 0)


def _touched(table: DataFrame, source: DataFrame, by: list[str], delete: str | Sequence[str] | None) -> DataFrame:
    own = source.select(*by)
    if delete is None:
        return own
    if delete == "all":
        return own.union(table.select(*by))
    scope = list(delete)
    if set(by) <= set(scope):
        return own
    scopes = source.select(*scope).distinct()
    return own.union(table.select(*{*by, *scope}).join(scopes, scope, "left_semi").select(*by))


def _values(partitions: DataFrame) -> set[tuple]:
    return {tuple(row) for row in partitions.distinct().collect()}


def _in(values: set[tuple], by: list[str], schema: StructType) -> Column:
    """Whether a row lies in one of some partitions; NULLs of a struct equal each other."""
    def literal(row: tuple) -> Column:
        return F.struct(*(F.lit(v).cast(schema[c].dataType).alias(c) for c, v in zip(by, row)))

    return F.struct(*by).isin([literal(row) for row in values]) if values else F.lit(False)
