from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions.temporal import at
from millrace.operators import validate as v
from millrace.plans import config_load
from millrace.schemas import CONTROL
from millrace.sources import documents
from millrace.sources.staging import scratch_path
from millrace.streaming import counted, daily, flows, ledger, quarantine, sync
from millrace.workload import streams

YAML = "jobs:\n  {job}:\n    tasks:\n      - {{task_key: {task}, task_type: notebook, file_path: p}}\n"


def numbers(spark, folder, low, high):
    spark.range(low, high).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).coalesce(1).write.mode("append").parquet(folder)


def test_append_flow_reads_each_file_once(spark, rows, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    numbers(spark, f"{source}/sub", 0, 3)
    schema = spark.read.parquet(f"{source}/sub").schema

    def run():
        arrivals = flows.file_arrivals(spark, source, schema, glob="*.parquet")
        flows.append_flow(arrivals, lambda df: df.filter("k <> 1"), target, checkpoint).awaitTermination()
        return rows(spark.read.parquet(target), "k")

    assert run() == [(0,), (2,)]
    assert run() == [(0,), (2,)]
    numbers(spark, f"{source}/sub", 3, 5)
    assert run() == [(0,), (2,), (3,), (4,)]


def test_table_updates(spark, rows, tmp_path):
    spark.range(3).write.mode("overwrite").saveAsTable("stream_source")
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    run = lambda: flows.append_flow(flows.table_updates(spark, "stream_source"), lambda df: df, target, checkpoint).awaitTermination()
    run()
    spark.range(3, 5).write.mode("append").saveAsTable("stream_source")
    run()
    assert rows(spark.read.parquet(target)) == [(i,) for i in range(5)]


def test_interval_flow_stays_on_until_stopped(spark, rows, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    numbers(spark, source, 0, 3)
    arrivals = flows.file_arrivals(spark, source, spark.read.parquet(source).schema)
    query = flows.append_flow(arrivals, lambda df: df, target, checkpoint, interval="1 second")
    query.processAllAvailable()
    numbers(spark, source, 3, 4)
    query.processAllAvailable()
    assert query.isActive
    query.stop()
    assert spark.read.parquet(target).count() == 4


def test_a_repeated_batch_gives_the_same_snapshot(spark, rows, tmp_path):
    root = str(tmp_path / "root")
    target = spark.createDataFrame([(1, 1), (2, 1)], "k long, v long")
    sync.seed(target, root)
    for i, batch in enumerate([[(1, 5)], [(3, 5)], [(3, 5)]]):
        number = min(i, 1)
        old = sync.snapshot(spark, root, target.schema, number)
        new = sync.merge(old, spark.createDataFrame(batch, target.schema), ["k"])
        ledger.write(new, root, number)
    assert sync.newest(spark, root) == 1 and sync.newest(spark, root, 1) == 0
    assert rows(sync.snapshot(spark, root, target.schema)) == [(1, 5), (2, 1), (3, 5)]


def test_an_empty_snapshot_is_the_newest(spark, tmp_path):
    root = str(tmp_path / "root")
    target = spark.createDataFrame([(1,)], "k long")
    sync.seed(target, root)
    ledger.write(target.limit(0), root, 0)
    assert sync.snapshot(spark, root, target.schema).count() == 0


def test_a_snapshot_that_is_not_whole_is_not_read(spark, rows, tmp_path):
    root = str(tmp_path / "root")
    target = spark.createDataFrame([(1,)], "k long")
    with pytest.raises(ValueError):
        sync.newest(spark, root)
    sync.seed(target, root)
    spark.createDataFrame([(7,)], "k long").write.parquet(ledger.batch_path(root, 0))  # stopped before its ledger entry
    assert sync.newest(spark, root) == sync.SEED
    assert rows(sync.snapshot(spark, root, target.schema)) == [(1,)]
    assert rows(ledger.batches(spark, root, target.schema), "k") == [(1,)]


def turns(spark, folder, *values):
    frame = spark.createDataFrame(list(values), "g string, k long, bad boolean")
    frame.coalesce(1).write.mode("append").parquet(folder)
    return frame.schema


def test_a_bad_row_rejects_its_group_in_all_batches(spark, rows, tmp_path):
    source, root, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    batches = [
        [("a", 1, False), ("b", 1, False), ("c", 1, True), (None, 1, False)],
        [("a", 2, False), ("b", 2, True), ("c", 2, False)],
        [("a", 3, False), ("b", 3, False), (None, 2, True)],
        [("a", 4, False), ("b", 4, True), (None, 3, False), ("d", 1, False)],
    ]
    seen = []
    for values in batches:
        schema = turns(spark, source, *values)
        arrivals = flows.file_arrivals(spark, source, schema, files_per_batch=1)
        check = lambda batch: v.with_reasons(batch, {"bad": F.col("bad")})
        quarantine.quarantine_flow(arrivals, check, ["g"], root, checkpoint).awaitTermination()
        accepted, rejected = quarantine.quarantined(spark, root, schema, ["g"])
        seen += values
        wrong = {g for g, _, b in seen if b}
        order = lambda r: (str(r[0]), r[1])
        assert sorted(rows(accepted, "g", "k"), key=order) == sorted(((g, k) for g, k, _ in seen if g not in wrong), key=order)
        found = sorted(((r.g, r.k, list(r.reasons)) for r in rejected.collect()), key=order)
        assert found == sorted(((g, k, ["bad"] if b else []) for g, k, b in seen if g in wrong), key=order)
    assert rows(ledger.finished(spark, f"{root}/accepted"), "batch_id") == [(0,), (1,), (2,), (3,)]
    retracted = ledger.batches(spark, f"{root}/retracted", schema)
    assert rows(retracted, "batch_id", "g", "k") == [(1, "b", 1), (2, None, 1)]
    assert rows(ledger.batches(spark, f"{root}/bad", schema), "batch_id", "g") == [(0, "c"), (1, "b"), (2, None)]


def test_a_repeated_quarantine_batch_changes_nothing(spark, rows, tmp_path, monkeypatch):
    source, root, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = turns(spark, source, ("a", 1, False), ("b", 1, False))
    run = lambda: quarantine.quarantine_flow(
        flows.file_arrivals(spark, source, schema), lambda batch: v.with_reasons(batch, {"bad": F.col("bad")}), ["g"], root, checkpoint
    ).awaitTermination()
    run()
    turns(spark, source, ("a", 2, True), ("b", 2, False))
    write = ledger.write

    def stopped(df, folder, batch_id):
        if folder.endswith("retracted"):
            raise RuntimeError("stopped")
        write(df, folder, batch_id)

    monkeypatch.setattr(ledger, "write", stopped)
    with pytest.raises(Exception, match="stopped"):
        run()
    monkeypatch.setattr(ledger, "write", write)
    assert rows(quarantine.quarantined(spark, root, schema, ["g"])[0], "g", "k") == [("a", 1), ("b", 1)]
    run()
    accepted, rejected = quarantine.quarantined(spark, root, schema, ["g"])
    assert rows(accepted, "g", "k") == [("b", 1), ("b", 2)] and rows(rejected, "g", "k") == [("a", 1), ("a", 2)]


def test_batches_are_counted_and_not_written_twice(spark, rows, tmp_path):
    source, root, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    numbers(spark, source, 0, 4)
    schema = spark.read.parquet(source).schema

    def run():
        arrivals = flows.file_arrivals(spark, source, schema, files_per_batch=1)
        counted.counted_flow(arrivals, lambda df: df.filter("k % 2 = 0"), root, checkpoint).awaitTermination()

    run()
    numbers(spark, source, 4, 9)
    ledger.record(spark, root, 1, 0, 0, 0)  # as if batch 1 had ended before its checkpoint was written
    spark.createDataFrame([(4, 40)], schema).write.parquet(ledger.batch_path(root, 1))
    run()
    numbers(spark, source, 9, 10)
    run()
    assert rows(ledger.finished(spark, root), "batch_id", "rows_read", "rows_kept", "rows_written") == [(0, 4, 2, 2), (1, 0, 0, 0), (2, 1, 0, 0)]
    assert rows(ledger.batches(spark, root, schema), "k") == [(0,), (2,), (4,)]


def test_daily_sums_of_batches_equal_the_summary(spark, rows, tmp_path):
    from millrace.operators.aggregate import daily_summary

    source, root, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "order_date string, customer_id string, revenue decimal(10,2), quantity int, status string"
    parts = [
        [("d1", "a", "1.50", 1, "C"), ("d1", "b", "2.00", None, "x"), (None, "a", "1.00", 1, "C")],
        [("d1", "a", None, 2, "C"), ("d2", None, "5.25", 1, "C")],
        [("d1", "c", "0.25", 1, "C"), ("d2", "a", "1.00", 3, None), (None, "a", "1.00", 1, "C"), (None, "b", None, 1, "C")],
    ]
    frames = [spark.createDataFrame([(d, c, r and Decimal(r), q, s) for d, c, r, q, s in part], schema) for part in parts]
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(source)
        arrivals = flows.file_arrivals(spark, source, frame.schema, files_per_batch=1)
        daily.daily_flow(arrivals, lambda batch: batch, frame.schema, root, checkpoint, done="C").awaitTermination()
    assert ledger.finished(spark, f"{root}/sums").count() == 3
    moment = at("2024-01-01", "timestamp")
    whole = daily_summary(frames[0].union(frames[1]).union(frames[2]), moment, "C")
    found = daily.daily_so_far(spark, frames[0].schema, root, moment)
    assert rows(found) == rows(whole) and found.columns == whole.columns


def test_documents_are_synced_into_the_control_table(spark, rows, tmp_path):
    folder = tmp_path / "docs"
    (folder / "sub").mkdir(parents=True)
    root, rejects, checkpoint = (str(tmp_path / x) for x in ("control", "rejects", "cp"))
    sync.seed(spark.createDataFrame([], CONTROL), root)

    def run():
        arrivals = flows.document_arrivals(spark, str(folder), documents.YAML_GLOB)
        sync.control_flow(
            arrivals, documents.yaml_jobs,
            lambda table, jobs, as_of: config_load.load_isolated(table, jobs, as_of, F.lit("sync")),
            root, rejects, CONTROL, checkpoint, lambda batch: at(f"2024-01-{batch + 1:02d}", "timestamp"),
        ).awaitTermination()
        return rows(sync.snapshot(spark, root, CONTROL), "resource_id", "task_key")

    (folder / "a.yaml").write_text(YAML.format(job="a", task="t"))
    (folder / "note.txt").write_text("no document")
    assert run() == [("a", "t")]
    (folder / "sub" / "b.yml").write_text(YAML.format(job="b", task="t"))
    (folder / "broken.yaml").write_text("jobs: [")
    (folder / "a2.yaml").write_text(YAML.format(job="a", task="u"))
    assert run() == [("a", "u"), ("b", "t")]
    assert rows(spark.read.parquet(rejects), "reason") == [("invalid_document",)]
    assert {r.created_timestamp.day for r in sync.snapshot(spark, root, CONTROL).collect()} == {2}


def test_arrivals_are_batches_of_files_that_a_task_can_read(spark, monkeypatch):
    """A larger table makes more files, not larger ones, and no more batches."""
    monkeypatch.setattr(streams, "ROWS", 1_000, raising=False)
    df = spark.range(0, 19_000, 1, 8).withColumn("value", F.xxhash64("id"))
    batches = []
    found = streams._arrivals(spark, None, "arrivals", df).withColumn("file", F.input_file_name())
    keep = lambda batch, number: batches.append(batch.collect())
    found.writeStream.foreachBatch(keep).option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert len(batches) == streams.BATCHES
    rows = [r for batch in batches for r in batch]
    assert sorted((r.id, r.value) for r in rows) == sorted((r.id, r.value) for r in df.collect())
    assert len({r.file for r in rows}) == 20
    empty = streams._arrivals(spark, None, "arrivals", df.limit(0))
    root = scratch_path(spark, "none")
    flows.append_flow(empty, lambda d: d, root, scratch_path(spark, "checkpoint")).awaitTermination()
    assert spark.read.parquet(root).count() == 0
