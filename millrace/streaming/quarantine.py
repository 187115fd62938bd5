"""Streams split into sound and bad groups, remembered from batch to batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from millrace.sources.staging import stage
from millrace.streaming import ledger
from millrace.streaming.flows import trigger


@dataclass(frozen=True)
class Quarantine:
    """Folders of a stream split by groups; each holds a folder per batch.

    accepted   rows of groups that were sound so far
    rejected   rows of groups that were bad by then, with their reasons
    retracted  rows accepted by earlier batches whose group turned bad in this one
    bad        keys of the groups that turned bad in this batch
    """

    root: str

    def part(self, name: str) -> str:
        return f"{self.root}/{name}"


def quarantine_flow(
    stream: DataFrame,
    check: Callable[[DataFrame], DataFrame],
    group: list[str],
    root: str,
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Split a stream: sound groups go on, bad ones go to a side folder with their reasons.

    One bad row rejects its whole group, in whichever batch the others come. The state is
    a table of the keys of bad groups: rows of a known bad group are rejected at once, and
    when a group turns bad, the rows accepted before are retracted. Nothing is kept for a
    sound group, no group is gathered, and a key that most rows share costs a semi join.
    A repeated batch reads only batches below it and overwrites its own output.
    """
    place, schema = Quarantine(root), stream.schema

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        checked = stage(check(batch), "checked")
        keys = StructType([schema[c] for c in group])
        known = ledger.batches(spark, place.part("bad"), keys, batch_id).drop("batch_id")
        now = checked.filter(F.size("reasons") > 0).select(*group).distinct()
        turned = stage(_without(now, known, group), "turned")
        bad = turned.unionByName(known)
        accepted = ledger.batches(spark, place.part("accepted"), schema, batch_id)
        no_reason = F.array().cast(checked.schema["reasons"].dataType).alias("reasons")
        ledger.write(turned, place.part("bad"), batch_id)
        ledger.write(_without(checked, bad, group).drop("reasons"), place.part("accepted"), batch_id)
        ledger.write(_with(checked, bad, group), place.part("rejected"), batch_id)
        ledger.write(_with(accepted, turned, group).select(*schema.names, no_reason), place.part("retracted"), batch_id)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return trigger(writer, interval).start()


def _same(left: DataFrame, right: DataFrame, group: list[str]) -> Column:
    """Equal keys; a NULL group is a group."""
    return reduce(and_, [left[c].eqNullSafe(right[c]) for c in group])


def _with(rows: DataFrame, keys: DataFrame, group: list[str]) -> DataFrame:
    return rows.join(keys, _same(rows, keys, group), "left_semi")


def _without(rows: DataFrame, keys: DataFrame, group: list[str]) -> DataFrame:
    return rows.join(keys, _same(rows, keys, group), "left_anti")


def quarantined(spark: SparkSession, root: str, schema: StructType, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reasons) of all whole batches: rows retracted since are among the rejected."""
    place, last = Quarantine(root), ledger.newest(spark, Quarantine(root).part("retracted"))
    below = 0 if last is None else last + 1
    bad = ledger.batches(spark, place.part("bad"), StructType([schema[c] for c in group]), below).drop("batch_id")
    accepted = _without(ledger.batches(spark, place.part("accepted"), schema, below).drop("batch_id"), bad, group)
    with_reasons = StructType([*schema.fields, StructField("reasons", ArrayType(StringType(), True))])
    parts = (ledger.batches(spark, place.part(name), with_reasons, below).drop("batch_id") for name in ("rejected", "retracted"))
    return accepted, reduce(DataFrame.unionByName, parts)
