from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators import changes as c


def control(spark, *values):
    return spark.createDataFrame(
        [(r, t, datetime(2024, 1, a), datetime(2024, 1, b), d) for r, t, a, b, d in values],
        "resource_id string, task_key string, created_timestamp timestamp, updated_timestamp timestamp, disabled boolean")


def test_first_run_makes_every_job_new(spark, rows):
    df = control(spark, ("a", "t", 1, 1, False), ("a", "u", 1, 1, False), ("b", "t", 1, 1, False))
    assert rows(c.changes_first(df)) == [("a", None, "new"), ("b", None, "new")]


def test_later_runs(spark, rows):
    df = control(
        spark, ("a", "new", 5, 5, False), ("a", "old", 1, 1, False), ("b", "off", 1, 6, True), ("c", "same", 1, 3, False),
        ("d", "null", 1, 6, None))
    assert rows(c.changes_since(df, "2024-01-03 00:00:00")) == [
        ("a", None, "updated"), ("a", "new", "new"), ("b", None, "disabled"), ("b", None, "updated"), ("d", None, "updated")]
    assert c.next_watermark(df).first()["watermark"] == datetime(2024, 1, 6)


def test_decisions(spark, rows):
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "resource_id string")
    ids = spark.createDataFrame([("a", 1), ("b", 2)], "resource_id string, job_id long")
    live = spark.createDataFrame([(1,), (1,), (9,)], "job_id long")
    assert rows(c.create_or_update(jobs, ids, live), "resource_id", "action") == [("a", "UPDATE"), ("b", "RECREATE"), ("c", "CREATE")]


def test_file_diff_sees_edits_in_place(spark, rows):
    listing = lambda *v: spark.createDataFrame(list(v), "path string, size long, mtime long")
    old = listing(("kept", 1, 1), ("edited", 1, 1), ("touched", 1, 1), ("gone", 1, 1))
    new = listing(("kept", 1, 1), ("edited", 2, 1), ("touched", 1, 2), ("added", 1, 1))
    assert rows(c.file_diff(old, new)) == [("added", "new"), ("edited", "modified"), ("gone", "deleted"), ("touched", "modified")]


def test_escalation(spark, rows):
    keys = spark.createDataFrame([("a",)], "k string")
    every = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    changed = spark.createDataFrame([("f", "new")], "path string, action string")
    assert rows(c.escalate(keys, every, changed)) == [("a",), ("b",)]
    assert rows(c.escalate(keys, every, changed.limit(0))) == [("a",)]
