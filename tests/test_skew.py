"""One key holds a third of the rows; results stay whole and the rows stay spread out."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph as g
from millrace.operators import merge as m
from millrace.operators import ranking, validate as v

N = 30_000


@pytest.fixture(scope="module")
def hot(spark):
    """k is 0 for a third of the rows, and unique otherwise."""
    ids = spark.range(N)
    return ids.select(F.when(F.col("id") < N // 3, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("n"))


def test_newest_row_of_a_hot_key(hot):
    newest = ranking.newest_per_key(hot, ["k"], "n")
    assert newest.count() == N - N // 3 + 1
    assert newest.filter("k = 0").first()["n"] == N // 3 - 1


def test_quarantine_of_a_hot_group(hot):
    checked = v.with_reasons(hot, {"bad": F.col("n") == 5})
    accepted, rejected = v.quarantine(checked, ["k"])
    assert (accepted.count(), rejected.count()) == (N - N // 3, N // 3)


def test_repeats_of_a_hot_key(rows, hot):
    assert rows(v.repeated_keys(hot, ["k"])) == [(0, N // 3)]


@pytest.mark.parametrize("how", ["left", "full"])
def test_null_keys_are_spread_over_the_tasks(spark, hot, how):
    target = hot.select(F.when(F.col("k") != 0, F.col("k")).alias("k"), "n")
    source = target.withColumn("n", F.col("n") + 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        merged = m.upsert(target, source, ["k"], how=how, with_action=True).select("k", "action", F.spark_partition_id().alias("part"))
        assert merged.count() == N + N // 3
        kept = merged.filter("k IS NULL AND action = 'keep'").groupBy("part").count().agg(F.max("count"), F.sum("count")).first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert kept[1] == N // 3 and kept[0] < N // 6


def test_a_task_that_most_others_depend_on(spark, rows):
    ids = spark.range(1, N)
    tasks = ids.select(F.lit("j").alias("resource_id"), F.col("id").cast("string").alias("task_key")).union(
        spark.createDataFrame([("j", "hub"), ("j", "end")], "resource_id string, task_key string"))
    edges = ids.select(F.lit("j").alias("resource_id"), F.col("id").cast("string").alias("task_key"), F.lit("hub").alias("dep_key")).union(
        ids.select(F.lit("j"), F.lit("end"), F.col("id").cast("string")))
    levels = g.topological_levels(tasks, edges, ["resource_id"], "task_key").groupBy("level").count()
    assert rows(levels) == [(0, 1), (1, N - 1), (2, 1)]


def test_nothing_to_order(spark):
    none = "resource_id string, task_key string"
    tasks, edges = spark.createDataFrame([], none), spark.createDataFrame([], none + ", dep_key string")
    assert g.topological_levels(tasks, edges, ["resource_id"], "task_key").count() == 0
    some = spark.createDataFrame([("j", "a")], none)
    assert g.topological_levels(some, edges, ["resource_id"], "task_key").count() == 1
    assert g.topological_levels(some.limit(0), edges.limit(0), ["resource_id"], "task_key").count() == 0


def tasks_of(df, condition="true"):
    """Rows per partition of a result."""
    parts = df.filter(condition).groupBy(F.spark_partition_id().alias("part")).count().collect()
    return sorted(r["count"] for r in parts)


@pytest.fixture
def shuffled(spark):
    """Joins are shuffled into 16 partitions that nothing splits or merges afterwards."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.files.maxPartitionBytes": "40k",
            "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["left", "full"])
def test_a_third_of_the_source_on_one_key(spark, hot, shuffled, how):
    target = spark.range(N, 2 * N).select(F.col("id").alias("k"), F.lit(-1).cast("long").alias("n"))
    merged = m.upsert(target, hot.repartition(16), ["k"], how=how, with_action=True)
    assert merged.groupBy("action").count().collect() and merged.count() == 2 * N
    sizes = tasks_of(merged, "action = 'insert'")
    assert sum(sizes) == N and max(sizes) <= 3 * sizes[len(sizes) // 2]


def test_a_third_of_the_target_on_one_key(spark, hot, shuffled):
    source = hot.select("k").distinct().withColumn("n", F.lit(-1).cast("long")).union(
        spark.createDataFrame([(10 * N, 5)], "k long, n long"))
    merged = m.upsert(hot.repartition(16), source, ["k"], how="full", with_action=True)
    assert merged.count() == N + 1 and merged.filter("action = 'update' AND n = -1").count() == N
    sizes = tasks_of(merged)
    assert max(sizes) <= 3 * sizes[len(sizes) // 2]


def test_heavy_keys_that_the_source_lacks_or_shares_are_kept_apart(spark, rows):
    target = spark.range(900).selectExpr("CASE WHEN id < 300 THEN 'a' WHEN id < 600 THEN 'b' ELSE CAST(id AS STRING) END AS k", "id AS v")
    source = spark.createDataFrame([("a", -1), ("700", -2), ("new", -3)], "k string, v long")
    merged = m.reconcile(target, source, ["k"], "all", keep_deleted=True, with_action=True)
    assert rows(m.action_counts(merged)) == [("delete", 599), ("insert", 1), ("update", 301)]


def test_rows_without_an_id_are_spread(spark, hot, shuffled):
    from millrace.operators.changes import create_or_update

    rows_ = hot.select(F.col("n").alias("resource_id"))
    ids = hot.filter("n < 100").select(F.col("n").alias("resource_id"), F.col("n").alias("job_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = create_or_update(rows_, ids, ids.select("job_id").filter("job_id < 50"))
        sizes = tasks_of(found, "action = 'CREATE'")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == N - 100 and max(sizes) <= 2 * sizes[len(sizes) // 2]
    assert found.columns == ["job_id", "resource_id", "action"]
