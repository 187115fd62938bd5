"""Micro-batch merges into a folder of snapshots.

Batch n reads the newest whole snapshot below n and writes snapshot n, then its entry in the
ledger. A batch that is repeated after a failure therefore reads the same input and overwrites its own
output, and its audit time is the batch's own, not the clock's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from millrace.operators.merge import merge
from millrace.sinks.partitions import merge_partitions
from millrace.sources.staging import stage
from millrace.streaming import ledger
from millrace.streaming.flows import trigger

SEED = -1


def seed(target: DataFrame, root: str) -> None:
    """The snapshot before the first batch."""
    ledger.write(target, root, SEED)


def snapshot(spark: SparkSession, root: str, schema: StructType, below: int | None = None) -> DataFrame:
    """The newest whole snapshot, or the newest below a batch."""
    return spark.read.schema(schema).parquet(ledger.batch_path(root, newest(spark, root, below)))


def newest(spark: SparkSession, root: str, below: int | None = None) -> int:
    """Number of the newest whole snapshot; an empty snapshot counts too."""
    found = ledger.newest(spark, root, below)
    if found is None:
        raise ValueError(f"no snapshot below {root}")
    return found


def merge_flow(
    stream: DataFrame,
    root: str,
    schema: StructType,
    keys: list[str],
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    interval: str | None = None,
    **merge_options,
) -> StreamingQuery:
    """Merge each micro-batch into the newest snapshot. prepare leaves one row per key."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = snapshot(spark, root, schema, batch_id)
        merged = merge(target, stage(prepare(batch), "source"), keys, staged=True, **merge_options)
        ledger.write(merged, root, batch_id)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return trigger(writer, interval).start()


def partition_merge_flow(
    stream: DataFrame,
    path: str,
    schema: StructType,
    keys: list[str],
    partition_by: list[str],
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    interval: str | None = None,
    **merge_options,
) -> StreamingQuery:
    """Merge each micro-batch into a partitioned table, rewriting only the partitions it touches.

    For tables too large for whole snapshots. Merging a batch again gives the same rows.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        merge_partitions(batch.sparkSession, path, schema, prepare(batch), keys, partition_by, **merge_options)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return trigger(writer, interval).start()


def control_flow(
    documents: DataFrame,
    parse: Callable[[DataFrame], DataFrame],
    load: Callable[[DataFrame, DataFrame, Column], object],
    root: str,
    rejects_root: str,
    schema: StructType,
    checkpoint: str,
    batch_time: Callable[[int], Column],
    interval: str | None = None,
) -> StreamingQuery:
    """Load arriving documents into control-table snapshots; problems go to a side folder.

    load(control, jobs, as_of) is load_isolated or load_atomic with its options bound.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        control = snapshot(spark, root, schema, batch_id)
        result = load(control, parse(batch), batch_time(batch_id))
        ledger.write(result.problems, rejects_root, batch_id)
        ledger.write(result.table, root, batch_id)

    writer = documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return trigger(writer, interval).start()
