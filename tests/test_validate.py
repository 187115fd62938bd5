import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregate, ranking, validate as v

# Task type, settings and the codes they are rejected with.
TASKS = [
    ("notebook", {"file_path": "p"}, []),
    ("notebook", {}, ["notebook:missing:file_path"]),
    ("sql_query", {"sql_query": "SELECT 1", "warehouse_id": "w"}, []),
    ("sql_query", {"query_id": "q", "warehouse_id": "w"}, []),
    ("sql_query", {"warehouse_id": "w"}, ["sql_query:missing:sql_query|query_id"]),
    ("sql_query", {"sql_query": "SELECT 1", "warehouse_id": "YOUR_WAREHOUSE_ID"}, ["missing:warehouse_id"]),
    ("sql_file", {"warehouse_id": "w", "file_path": ""}, ["sql_file:missing:file_path"]),
    ("sql_file", {}, ["sql_file:missing:file_path", "missing:warehouse_id"]),
    ("python_wheel", {"package_name": "p"}, ["python_wheel:missing:entry_point"]),
    ("spark_jar", {}, ["spark_jar:missing:main_class_name"]),
    ("pipeline", {"pipeline_id": "x"}, []),
    ("dbt", {"commands": "dbt run"}, []),
    ("dbt", {"commands": ["dbt run", "  edr report"]}, []),
    ("dbt", {"commands": ["dbt run", "rm -r x"]}, ["bad_command"]),
    ("dbt", {"commands": []}, ["dbt:missing:commands"]),
    ("dbt", {}, ["dbt:missing:commands"]),
    ("shell", {}, ["unknown_type"]),
]


@pytest.mark.parametrize("default", [None, "shared"])
def test_fields_by_type(spark, default):
    df = spark.createDataFrame([(i, t, json.dumps(s)) for i, (t, s, _) in enumerate(TASKS)], "i int, task_type string, task_config string")
    warehouse = F.lit(default) if default else None
    got = {r.i: r.reasons for r in v.with_type_reasons(df, default_warehouse=warehouse).collect()}
    want = {i: [c for c in codes if not (default and c == "missing:warehouse_id")] for i, (_, _, codes) in enumerate(TASKS)}
    assert got == want


def checked(spark, *values):
    df = spark.createDataFrame(list(values), "g string, n int")
    return v.with_reasons(df, {"negative": F.col("n") < 0, "odd": F.col("n") % 2 == 1})


def test_one_bad_row_rejects_its_group(spark, rows):
    df = checked(spark, ("a", 2), ("a", -2), ("b", 2), ("c", 1), ("c", 3), ("d", None))
    accepted, rejected = v.quarantine(df, ["g"])
    assert rows(accepted) == [("b", 2), ("d", None)]
    assert rows(rejected, "g", "n") == [("a", -2), ("a", 2), ("c", 1), ("c", 3)]
    assert rows(v.rejected_groups(df, ["g"])) == [("a", 1, "negative"), ("c", 2, "odd")]
    assert tuple(v.load_summary(accepted, rejected, "g").first()) == (2, 2, 2)


def test_gate(spark):
    assert v.all_or_nothing(checked(spark, ("a", 2), ("b", 4))).count() == 2
    assert v.all_or_nothing(checked(spark, ("a", 2), ("b", -4))).count() == 0
    assert v.all_or_nothing(checked(spark, ("a", 2)).limit(0)).count() == 0


def test_collisions(spark, rows):
    df = spark.createDataFrame([("j", "a-b"), ("j", "a.b"), ("j", "c"), ("j", "c"), ("k", "a-b")], "g string, task_key string")
    assert rows(v.key_collisions(df, ["g"], "task_key")) == [("j", "a_b", 2)]


def test_freshness(spark, rows):
    audit = spark.createDataFrame(
        [("exact", "2024-01-01 00:00:00"), ("hour", "2024-01-01 23:30:00"), ("old", "2023-12-31 22:00:00"),
         ("old", "2023-12-30 22:00:00"), ("null", None)], "table_name string, t string"
    ).select("table_name", F.col("t").cast("timestamp").alias("last_update_time"))
    expected = spark.createDataFrame([(n,) for n in ("exact", "hour", "old", "null", "empty")], "table_name string")
    result = aggregate.freshness(audit, F.lit("2024-01-02 00:29:00").cast("timestamp"), 24, expected)
    assert rows(result, "table_name", "hours_since_update", "freshness_status") == [
        ("empty", None, "NO_DATA"), ("exact", 24, "FRESH"), ("hour", 0, "FRESH"), ("null", None, "NO_DATA"), ("old", 26, "STALE")]


def test_newest_per_key(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "w")], "k string, t int, v string")
    assert rows(ranking.newest_per_key(df, ["k"], "t", [F.col("v")])) == [("a", 2, "y"), ("b", None, "w")]


def test_latest_falls_back(spark):
    empty = spark.createDataFrame([], "t timestamp")
    assert aggregate.latest(empty, "t").first()["t"] == datetime(1970, 1, 1)


def test_load_status(spark):
    counts = spark.createDataFrame([(5, 3, 3), (5, 3, 2)], "rows_read long, rows_kept long, rows_in_target long")
    assert [r.status for r in v.load_status(counts).collect()] == ["SUCCESS", "FAILED"]


def test_outcomes_of_groups(spark, rows):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "late"), ("b", None), ("b", "early")], "g string, error string")
    assert rows(v.run_outcomes(df, "g")) == [("a", "succeeded", None), ("b", "failed", "early")]


def test_keys_that_collide(spark, rows):
    df = spark.createDataFrame([("j", "a-b"), ("j", "a_b"), ("j", "c"), ("k", "a-b"), ("j", "a-b")], "g string, task_key string")
    assert rows(v.colliding_keys(df, ["g"], "task_key")) == [("j", "a-b"), ("j", "a_b")]


def test_load_summary_with_deletions(spark):
    accepted = spark.createDataFrame([("a",), ("a",)], "g string")
    actions = spark.createDataFrame([("delete",), ("keep",), ("delete",)], "action string")
    assert tuple(v.load_summary(accepted, accepted.limit(0), "g", actions).first()) == (2, 1, 0, 2)
