import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators.validate import load_status
from millrace.sinks.partitions import merge_partitions
from millrace.operators.changes import file_diff
from millrace.schemas import CONTROL
from millrace.sinks import partitions, tables as sinks
from millrace.sources import documents, files, staging, tables

SOUND = "jobs:\n  a:\n    name: A\n    tasks:\n      - {task_key: t, task_type: notebook, file_path: p}\n"


@pytest.fixture
def name():
    return f"t_{uuid.uuid4().hex[:8]}"


def test_documents_of_a_folder(spark, rows, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.yaml").write_text(SOUND)
    (tmp_path / "sub" / "two.yml").write_text(SOUND.replace("  a:", "  é:"))
    (tmp_path / "notes.txt").write_text("jobs: {}")
    (tmp_path / "broken.yaml").write_text("jobs: [unclosed")
    (tmp_path / "list.yaml").write_text("jobs: [1, 2]")
    (tmp_path / "empty.yaml").write_text("# nothing yet\n")
    (tmp_path / "none.yaml").write_text("jobs: {}")
    (tmp_path / "bytes.yaml").write_text("")
    (tmp_path / "date.yaml").write_text("jobs:\n  a:\n    day: 2024-13-45")
    (tmp_path / "keys.yaml").write_text("jobs:\n  k:\n    2024-01-02: x")
    (tmp_path / "nan.yaml").write_text("jobs:\n  a:\n    n: .nan")
    read = documents.read_documents(spark, str(tmp_path))
    assert read.count() == 10
    jobs = documents.yaml_jobs(read).select(documents.file_name(F.col("path")).alias("file"), "resource_id", "reason")
    assert rows(jobs) == [
        ("broken.yaml", None, "invalid_document"), ("bytes.yaml", None, "empty_document"), ("date.yaml", None, "invalid_document"),
        ("empty.yaml", None, "no_jobs_key"), ("keys.yaml", "k", None), ("list.yaml", None, "jobs_not_a_mapping"),
        ("nan.yaml", None, "invalid_document"), ("one.yaml", "a", None), ("two.yml", "é", None)]


def test_json_documents_match_yaml_ones(spark, rows):
    texts = ['{"jobs": {"a": {"tasks": [1]}, "b": null}}', "{}", '{"jobs": null}', '{"jobs": [1]}', "{oops", '{"jobs": {}}',
             '{"jobs": {"a": {"x": 1}, "b": 2, "a": {"x": 3}, "c": 4, "c": 4}}', None, "[1, 1]"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    keep = ["path", "resource_id", "reason"]
    assert rows(documents.json_jobs(df).select(keep)) == rows(documents.yaml_jobs(df).select(keep))


def test_file_listings_show_what_changed(spark, rows, tmp_path):
    for name in ("edited", "gone", "kept"):
        (tmp_path / f"{name}.yaml").write_text("x")
    before = staging.stage(files.list_files(spark, str(tmp_path), "*.yaml"), "before")
    (tmp_path / "edited.yaml").write_text("longer")
    (tmp_path / "gone.yaml").unlink()
    (tmp_path / "added.yaml").write_text("x")
    diff = file_diff(before, files.list_files(spark, str(tmp_path), "*.yaml"))
    names = diff.select(documents.file_name(F.col("path")).alias("file"), "action")
    assert rows(names) == [("added.yaml", "new"), ("edited.yaml", "modified"), ("gone.yaml", "deleted")]


def test_only_a_missing_table_falls_back(spark, name):
    sample = spark.createDataFrame([(1,)], "a int")
    assert tables.scan_or_sample(spark, name, sample).count() == 1
    sample.union(sample).write.mode("append").saveAsTable(name)
    assert tables.scan_or_sample(spark, name, sample).count() == 3
    assert tables.scan_identifier(spark, "default", name).count() == 3
    with pytest.raises(ValueError):
        tables.full_name("c", "", "t")


def test_defaults_of_the_control_table(spark, name):
    sinks.create_control_table(spark, name)
    sinks.create_control_table(spark, name)
    spark.sql(f"INSERT INTO {name} (resource_id, task_key) VALUES ('r', 't')")
    row = spark.table(name).first()
    assert row["disabled"] is False and isinstance(row["updated_timestamp"], datetime)
    assert spark.table(name).columns == CONTROL.names


def test_append_takes_new_columns(spark, rows, name):
    old = spark.createDataFrame([(1, "x")], "a int, b string")
    sinks.write_table(old, name)
    sinks.write_table(spark.createDataFrame([("n", 2)], "c string, a int"), name, "append")
    assert rows(spark.table(name), "a", "b", "c") == [(1, "x", None), (2, None, "n")]
    sinks.write_table(old, name)
    assert rows(spark.table(name)) == [(1, "x")]
    with pytest.raises(ValueError):
        sinks.write_table(old, name, "upsert")


def test_folder_append_merges_schemas(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    sinks.append_folder(spark.createDataFrame([(1,)], "a int"), path)
    assert rows(sinks.append_folder(spark.createDataFrame([(2, "x")], "a int, b string"), path)) == [(1, None), (2, "x")]


def test_replace_a_table_by_a_query_on_itself(spark, rows, name):
    sinks.write_table(spark.createDataFrame([(1,), (2,)], "a int"), name)
    sinks.replace_own_source(spark.table(name).filter("a > 1"), name)
    assert rows(spark.table(name)) == [(2,)]
    sinks.create_table_as(spark.createDataFrame([(9,)], "a int"), name)
    assert rows(spark.table(name)) == [(2,)]


def test_verified_write(spark, tmp_path):
    path = str(tmp_path / "out")
    counts = sinks.write_verified(
        spark.range(10), lambda df: df.filter("id > 6"), lambda df: df.write.parquet(path), lambda: spark.read.parquet(path).count())
    assert counts == {"rows_read": 10, "rows_kept": 3, "rows_before": 0, "rows_in_target": 3}


def test_merge_rewrites_only_touched_partitions(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 1, 1)], "p string, k int, v int")
    old.write.partitionBy("p").parquet(path)
    untouched = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "p=b").iterdir()}
    source = spark.createDataFrame([("a", 1, 9), ("c", 1, 9)], "p string, k int, v int")
    for _ in range(2):
        partitions.merge_partitions(spark, path, old.schema, source, ["p", "k"], ["p"])
        assert rows(spark.read.schema(old.schema).parquet(path), "p", "k", "v") == [("a", 1, 9), ("a", 2, 1), ("b", 1, 1), ("c", 1, 9)]
    assert untouched == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "p=b").iterdir()}
    with pytest.raises(ValueError):
        partitions.merge_partitions(spark, path, old.schema, source, ["k"], ["p"])


def test_staging_uses_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert staging.scratch_path(spark, "x").startswith(root)


def test_literal_rows_replaced_tables_and_views(spark, rows, name):
    literal = tables.rows(spark, [("a", None), ("b", 2)], "k string, v int")
    assert literal.schema.simpleString() == "struct<k:string,v:int>"
    sinks.replace_table(literal, name)
    sinks.replace_table(literal.filter("v = 2"), name)
    assert rows(tables.scan(spark, name)) == [("b", 2)]
    sinks.temp_view(literal, f"{name}_view")
    assert rows(tables.scan(spark, f"{name}_view")) == [("a", None), ("b", 2)]


def test_a_replaced_partitioned_table_keeps_no_old_partition(spark, rows, name):
    spark.range(10).selectExpr("id", "id % 2 AS part").write.partitionBy("part").saveAsTable(name)
    sinks.replace_own_source(spark.table(name).filter("part = 0"), name)
    assert spark.table(name).select("part").distinct().count() == 1


@pytest.mark.parametrize("mode, total, status", [("append", 6, "SUCCESS"), ("overwrite", 3, "SUCCESS"), ("ignore", 3, "SUCCESS")])
def test_verified_writes_to_an_existing_table(spark, name, mode, total, status):
    spark.range(3).write.saveAsTable(name)
    counts = sinks.write_verified(
        spark.range(10), lambda df: df.filter("id > 6"), lambda df: sinks.write_table(df, name, mode),
        lambda: spark.table(name).count(), mode, True)
    assert counts["rows_in_target"] == total
    frame = spark.createDataFrame([counts], "rows_read bigint, rows_kept bigint, rows_before bigint, rows_in_target bigint")
    assert load_status(frame).first()["status"] == status


def test_an_append_that_loses_rows_fails(spark):
    frame = spark.createDataFrame([(10, 3, 100, 102)], "rows_read bigint, rows_kept bigint, rows_before bigint, rows_in_target bigint")
    assert load_status(frame).first()["status"] == "FAILED"


def test_a_partition_merge_reads_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.range(100).selectExpr("id", "id % 10 AS part", "1 AS v").write.partitionBy("part").parquet(path)
    schema = spark.read.parquet(path).select("id", "v", "part").schema
    before = spark.read.parquet(path).count()
    source = spark.createDataFrame([(3, 9, 3)], schema)
    merge_partitions(spark, path, schema, source, ["id", "part"], ["part"], update=["v"])
    after = spark.read.schema(schema).parquet(path)
    assert after.count() == before and after.filter("v = 9").count() == 1


def partition_files(folder):
    return {f"{f.parent.name}/{f.name}": f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def merged_rows(spark, rows, path, schema):
    return rows(spark.read.schema(schema).parquet(str(path)), "p", "k", "v")


def test_a_partition_merge_keeps_the_null_partition(spark, rows, tmp_path):
    path = tmp_path / "t"
    old = spark.createDataFrame([(None, 1, "old"), ("a", 1, "old"), ("b", 1, "old"), ("c", 1, "old")], "p string, k int, v string")
    old.write.partitionBy("p").parquet(str(path))
    before = partition_files(path)
    source = spark.createDataFrame([(None, 9, "new"), ("a", 2, "new"), ("c", 1, "new")], old.schema)
    done = merge_partitions(spark, str(path), old.schema, source, ["p", "k"], ["p"])
    assert merged_rows(spark, rows, path, old.schema) == [
        (None, 1, "old"), (None, 9, "new"), ("a", 1, "old"), ("a", 2, "new"), ("b", 1, "old"), ("c", 1, "new")]
    # The partition between the touched ones is neither read nor written.
    assert (done.touched, done.written, done.emptied) == (3, 3, 0)
    kept = {f for f in before if f in partition_files(path) and partition_files(path)[f] == before[f]}
    assert {f.split("/")[0] for f in kept} == {"p=b"}


def test_a_partition_merge_reads_exactly_what_it_touches(spark, tmp_path):
    from millrace.sinks import partitions as p

    path = str(tmp_path / "t")
    schema = spark.range(0).selectExpr("id", "id AS x", "CAST(id AS STRING) AS y").schema
    spark.range(40).selectExpr("id", "id % 4 AS x", "CASE WHEN id % 5 > 0 THEN CAST(id % 5 AS STRING) END AS y").write.partitionBy("x", "y").parquet(path)
    here = spark.read.schema(schema).parquet(path).filter(p._in({(1, None), (3, "2")}, ["x", "y"], schema))
    assert {tuple(r) for r in here.select("x", "y").distinct().collect()} == {(1, None), (3, "2")}
    files = {r[0].split("/t/")[1].rsplit("/", 1)[0] for r in here.select("_metadata.file_path").distinct().collect()}
    assert files == {"x=1/y=__HIVE_DEFAULT_PARTITION__", "x=3/y=2"}
    assert "PartitionFilters: [" in here._jdf.queryExecution().toString() and "DataFilters: []" in here._jdf.queryExecution().toString()


@pytest.mark.parametrize("delete, left", [
    (None, [("a", 1, 9), ("a", 2, 1), ("b", 1, 1), ("b b/c", 1, 1), ("z", 5, 9)]),
    (["p"], [("a", 1, 9), ("b", 1, 1), ("b b/c", 1, 1), ("z", 5, 9)]),
    (["g"], [("a", 1, 9), ("b", 1, 1), ("z", 5, 9)]),
    ("all", [("a", 1, 9), ("z", 5, 9)]),
])
def test_a_partition_merge_deletes_and_empties_partitions(spark, rows, tmp_path, delete, left):
    path = tmp_path / "t"
    old = spark.createDataFrame([("a", 1, 1, "g"), ("a", 2, 1, "g"), ("b", 1, 1, "h"), ("b b/c", 1, 1, "g")], "p string, k int, v int, g string")
    old.write.partitionBy("p").parquet(str(path))
    source = spark.createDataFrame([("a", 1, 9, "g"), ("z", 5, 9, "g")], old.schema)
    for n in range(2):
        done = merge_partitions(spark, str(path), old.schema, source, ["p", "k"], ["p"], delete=delete)
        assert merged_rows(spark, rows, path, old.schema) == left
        if n == 0:
            assert done.emptied == {"all": 2}.get(delete if isinstance(delete, str) else "", 1 if delete == ["g"] else 0)


def test_a_bucketed_merge_does_not_shuffle_the_target(spark, rows, name):
    from millrace.operators import merge as m
    from millrace.sinks import buckets

    old = spark.range(2000).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    buckets.write_bucketed(old, name, ["k"], 8)
    source = spark.range(1500, 2500).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("left", "full"):
            plan = m.upsert(spark.table(name), source, ["k"], how=how, complete=True)._jdf.queryExecution().executedPlan().toString()
            lines = plan.split("\n")
            depth = lambda line: len(line) - len(line.lstrip(" :+-"))
            scans = [i for i, line in enumerate(lines) if "Bucketed: true" in line]
            assert scans
            for i in scans:
                above, level = [], depth(lines[i])
                for line in reversed(lines[:i]):
                    if depth(line) < level:
                        above.append(line)
                        level = depth(line)
                # Up to the first join there is no exchange above a scan of the target.
                below_join = above[: next(n for n, line in enumerate(above) if "Join" in line)]
                assert not [line for line in below_join if "Exchange" in line]
        buckets.replace_bucketed(spark, name, lambda target: m.upsert(target, source, ["k"], how="full", complete=True), ["k"], 8)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows(spark.table(name).groupBy("v").count()) == [(0, 1500), (1, 1000)]
    assert not spark.catalog.tableExists(f"{name}_next")
    again = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").first()
    assert again["data_type"] == "8"
    spark.sql(f"INSERT INTO {name} VALUES (NULL, 3)")
    with pytest.raises(ValueError, match="without k"):
        buckets.replace_bucketed(spark, name, lambda target: target, ["k"], 8)


def test_an_update_rewrites_only_partitions_with_such_rows(spark, rows, tmp_path):
    path = tmp_path / "t"
    old = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 1, 1), (None, 2, 1), ("c", 3, 1)], "p string, k int, v int")
    old.write.partitionBy("p").parquet(str(path))
    before = partition_files(path)
    done = partitions.update_partitions(spark, str(path), old.schema, F.col("k") == 2, {"v": F.lit(9)}, ["p"])
    assert merged_rows(spark, rows, path, old.schema) == [(None, 2, 9), ("a", 1, 1), ("a", 2, 9), ("b", 1, 1), ("c", 3, 1)]
    after = partition_files(path)
    assert done.touched == 2 and {f.split("/")[0] for f in before if after.get(f) == before[f]} == {"p=b", "p=c"}
    assert partitions.update_partitions(spark, str(path), old.schema, F.col("k") == 7, {"v": F.lit(0)}, ["p"]).touched == 0
    assert partition_files(path) == after
    with pytest.raises(ValueError):
        partitions.update_partitions(spark, str(path), old.schema, F.lit(True), {"p": F.lit("x")}, ["p"])
