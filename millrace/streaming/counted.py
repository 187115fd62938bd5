"""Flows whose batches are counted while they are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.streaming import ledger
from millrace.streaming.flows import trigger


def counted_flow(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    root: str,
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Row-wise flow into a folder per batch, with the rows read, kept and written in its ledger.

    Rows are counted while they are written, not by reading them again; only what was
    written is counted from the files' footers. A load that was stopped goes on from its
    checkpoint; a batch that comes again and is in the ledger already is not written twice.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if ledger.is_finished(spark, root, batch_id):
            return
        read, kept = Observation(), Observation()
        rows = transform(batch.observe(read, F.count(F.lit(1)).alias("n"))).observe(kept, F.count(F.lit(1)).alias("n"))
        path = ledger.batch_path(root, batch_id)
        rows.write.mode("overwrite").parquet(path)
        written = spark.read.schema(rows.schema).parquet(path).count()
        ledger.record(spark, root, batch_id, read.get["n"], kept.get["n"], written)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return trigger(writer, interval).start()
