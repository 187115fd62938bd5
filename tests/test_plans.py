import json
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.plans import config_load as load, job_plan, sales, tasks
from millrace.schemas import CONTROL, SILVER_SALES
from millrace.sources import documents

NOW = datetime(2024, 6, 1, 12)


def now():
    return F.lit("2024-06-01 12:00:00").cast("timestamp")


def test_sample_sales_to_daily(spark, rows):
    run = sales.sales_run(sales.sample_sales(spark, now()), now())
    day = run.daily.first()
    assert (day.total_orders, day.total_quantity, day.unique_customers, day.completed_orders) == (3, 8, 2, 2)
    assert float(day.total_revenue) == 353.75 and round(day.avg_order_value, 4) == 117.9167
    assert rows(run.silver, "order_id", "status") == [("S-1", "COMPLETED"), ("S-2", "COMPLETED"), ("S-3", "PENDING")]
    assert sales.daily_sales(run.silver, now(), "2024-06-01").count() == 1
    assert sales.daily_sales(run.silver, now(), "2024-06-02").count() == 0


def test_silver_drops_unusable_rows(spark, rows):
    bronze = sales.sample_sales(spark, now())
    broken = bronze.withColumns({
        "order_id": F.when(F.col("order_id") != "S-1", F.col("order_id")),
        "revenue": F.when(F.col("order_id") == "S-2", F.lit(0)).otherwise(F.col("revenue")),
    })
    assert rows(sales.to_silver(broken, now()), "order_id") == [("S-3",)]


def test_incremental_load_into_an_empty_table_and_again(spark, rows):
    bronze = sales.sample_sales(spark, now())
    empty = spark.createDataFrame([], SILVER_SALES)
    first = sales.incremental_load(empty, bronze.unionByName(bronze), now())
    assert first.count() == 3
    later = F.lit("2024-06-02 12:00:00").cast("timestamp")
    changed = bronze.withColumn("status", F.lit("returned")).withColumn("processed_at", later).filter("order_id = 'S-3'")
    again = sales.incremental_load(first, bronze.unionByName(changed), later)
    assert rows(again, "order_id", "status") == [("S-1", "COMPLETED"), ("S-2", "COMPLETED"), ("S-3", "RETURNED")]
    kept = again.filter("order_id = 'S-3'").first()
    assert kept.processed_at == NOW and kept.updated_at == datetime(2024, 6, 2, 12)


def test_script_statements():
    script = "-- a; b\nSELECT ';' AS x, \"a;b\", `c;d`; /* ; */ SELECT 'it''s;' ;\n-- end\n"
    assert tasks.statements(script) == ["-- a; b\nSELECT ';' AS x, \"a;b\", `c;d`", "/* ; */ SELECT 'it''s;'"]


def test_sql_file(spark, tmp_path):
    file = tmp_path / "task.sql"
    file.write_text("CREATE OR REPLACE TEMP VIEW v AS SELECT 5.0 AS a;\nSELECT CAST(:limit AS INT) + a AS s FROM v")
    assert float(tasks.run_sql_file(spark, str(file), {"limit": 3, "unused": "x"}).first()["s"]) == 8.0
    with pytest.raises(ValueError):
        tasks.run_script(spark, "-- nothing\n;")


def test_ingestion(spark, rows):
    name = f"c_{uuid.uuid4().hex[:8]}"
    columns = "customer_id string, first_name string, last_name string, email string, registration_date string, status string"
    sample = spark.createDataFrame(
        [("1", "John", "Doe", "j@x", "2024-01-15", "active"), ("2", None, "Smith", "s@x", "2024-01-16", "active"),
         ("3", "Bob", "J", "b@x", "2024-01-17", "inactive")], columns)
    task = tasks.Ingestion.of("load", {"catalog": "spark_catalog", "schema": "default", "source_table": f"{name}_s",
                                       "target_table": name, "write_mode": "append"})
    counts = tasks.ingest(spark, task, sample, now())
    assert counts == {"rows_read": 3, "rows_kept": 2, "rows_before": 0, "rows_in_target": 2}
    assert rows(spark.table(name), "customer_id", "full_name", "task_key") == [("1", "John Doe", "load"), ("2", None, "load")]
    assert tasks.ingest_then_validate(spark, task, sample, now()).first()["status"] == "SUCCESS"
    assert spark.table(name).count() == 4
    assert tasks.Ingestion.of("x", {"catalog": "a", "schema": "b", "source_table": "c", "target_table": "d"}).write_mode == "overwrite"
    with pytest.raises(ValueError, match="schema, target_table"):
        tasks.Ingestion.of("x", {"catalog": "a", "source_table": "c"})


def job(*task_list, **settings):
    return {"tasks": list(task_list), **settings}


def task(key, kind="notebook", deps=None, **settings):
    return {"task_key": key, "task_type": kind, "file_path": "p", **({"depends_on": deps} if deps is not None else {}), **settings}


def docs(spark, *jobs):
    return documents.json_jobs(
        spark.createDataFrame([(f"d{i}", json.dumps({"jobs": j})) for i, j in enumerate(jobs)], "path string, content string"))


def control(spark, *keys):
    values = [(r, r, t, "[]", "notebook", "{}", "{}", False, "ann", NOW, "ann", NOW) for r, t in keys]
    return spark.createDataFrame(values, CONTROL)


BAD = {
    "no_tasks": job(), "no_key": job({"task_type": "notebook"}), "no_type": job({"task_key": "a"}),
    "repeated": job(task("a"), task("a")), "missing": job(task("a", deps=["zz"])), "selfish": job(task("a", deps=["a"])),
    "cyclic": job(task("a", deps=["b"]), task("b", deps=["a"])), "bad_list": job(task("a", deps="b")),
    "numbers": job(task("a", deps=[1])), "templated": job(task("${var.nope}")), "scalar": 3,
}
CODES = {
    "no_tasks": {"no_tasks"}, "no_key": {"missing:task_key"}, "no_type": {"missing:task_type"},
    "repeated": {"repeated_task_key"}, "missing": {"missing_dependency"}, "selfish": {"self_dependency", "cycle"},
    "cyclic": {"cycle"}, "bad_list": {"depends_on_not_a_list_of_keys"}, "numbers": {"depends_on_not_a_list_of_keys"},
    "templated": {"undefined_variable"}, "scalar": {"job_not_a_mapping"},
}
GOOD = {"etl_${var.env}": job(task("a"), task("b", "sql_file", ["a", "a"], disabled=True, n=1), name="ETL ${var.env}", timeout_seconds=9, junk=1)}


def test_bad_jobs_are_left_out_and_the_others_load(spark, rows):
    table = control(spark, ("etl_dev", "a"), ("etl_dev", "old"), ("missing", "kept"), ("other", "kept"))
    result = load.load_isolated(table, docs(spark, {**BAD, **GOOD}), now(), F.lit("bob"), {"env": "dev"})
    reasons = {}
    for r in result.problems.collect():
        reasons.setdefault(r.resource_id, set()).add(r.reason)
    assert reasons == CODES
    assert rows(result.table, "resource_id", "task_key", "job_name", "created_by", "updated_by", "disabled") == [
        ("etl_dev", "a", "ETL dev", "ann", "bob", False), ("etl_dev", "b", "ETL dev", "bob", "bob", True),
        ("missing", "kept", "missing", "ann", "ann", False), ("other", "kept", "other", "ann", "ann", False)]
    b = result.table.filter("task_key = 'b'").first()
    assert json.loads(b.depends_on) == ["a", "a"] and json.loads(b.job_config) == {"timeout_seconds": 9}
    assert json.loads(b.task_config) == {"file_path": "p", "n": 1}
    assert rows(result.counts) == [("delete", 1), ("insert", 1), ("keep", 2), ("update", 1)]
    assert result.table.schema.names == CONTROL.names


@pytest.mark.parametrize("scope", ["touched", "all"])
def test_all_or_nothing(spark, rows, scope):
    table = control(spark, ("etl_dev", "old"), ("other", "kept"))
    bad = load.load_atomic(table, docs(spark, GOOD, {"x": job()}), now(), F.lit("bob"), {"env": "dev"}, scope=scope)
    assert rows(bad.table, "resource_id", "task_key") == [("etl_dev", "old"), ("other", "kept")]
    good = load.load_atomic(table, docs(spark, GOOD), now(), F.lit("bob"), {"env": "dev"}, scope=scope)
    left = [("other", "kept")] if scope == "touched" else []
    assert rows(good.table, "resource_id", "task_key") == [("etl_dev", "a"), ("etl_dev", "b"), *left]


def test_a_resource_id_in_two_documents(spark):
    result = load.load_atomic(control(spark), docs(spark, {"j": job(task("a"))}, {"j": job(task("b"))}), now(), F.lit("bob"))
    assert {(r.resource_id, r.reason) for r in result.problems.collect()} == {("j", "repeated_resource_id")}
    assert result.table.count() == 0


def test_documents_that_are_no_documents(spark):
    content = spark.createDataFrame([("d0", "{oops"), ("d1", json.dumps({"jobs": {"j": job(task("a"))}}))], "path string, content string")
    isolated = load.load_isolated(control(spark), documents.json_jobs(content), now(), F.lit("bob"))
    assert [(r.path, r.reason) for r in isolated.problems.collect()] == [("d0", "invalid_document")]
    assert isolated.table.count() == 1
    assert load.load_atomic(control(spark), documents.json_jobs(content), now(), F.lit("bob")).table.count() == 0


def test_strict_load_checks_types(spark):
    jobs = docs(spark, {"j": job(task("a", "shell")), "k": job({"task_key": "a", "task_type": "sql_query", "sql_query": "q"})})
    lax = load.load_isolated(control(spark), jobs, now(), F.lit("bob"))
    assert lax.problems.count() == 0
    strict = load.load_isolated(control(spark), jobs, now(), F.lit("bob"), strict=True)
    assert {(r.resource_id, r.reason) for r in strict.problems.collect()} == {("j", "unknown_type"), ("k", "missing:warehouse_id")}
    warehouse = load.load_isolated(control(spark), jobs, now(), F.lit("bob"), strict=True, default_warehouse=F.lit("w"))
    assert {r.resource_id for r in warehouse.problems.collect()} == {"j"}


def test_yaml_and_json_documents_load_alike(spark, rows, tmp_path):
    (tmp_path / "jobs.yaml").write_text(
        "# ${var.unused} in a comment\njobs:\n  etl_${var.env}:\n    name: ETL ${var.env}\n    timeout_seconds: 9\n    junk: 1\n    tasks:\n"
        "      - {task_key: a, task_type: notebook, file_path: p}\n"
        "      - {task_key: b, task_type: sql_file, file_path: p, depends_on: [a, a], disabled: true, n: 1}\n")
    yaml_jobs = documents.yaml_jobs(documents.read_documents(spark, str(tmp_path)))
    values = {"env": "dev"}
    found = [rows(load.load_isolated(control(spark), j, now(), F.lit("bob"), values).table) for j in (yaml_jobs, docs(spark, GOOD))]
    assert found[0] == found[1] and len(found[0]) == 2


def test_job_and_task_plans(spark, rows):
    table = control(spark, ("a", "x-1"), ("b", "y"), ("c", "z")).withColumn(
        "job_config", F.when(F.col("resource_id") == "a", '{"schedule": {"cron": "0"}}').otherwise("{}"))
    ids = spark.createDataFrame([("b", 1), ("c", 2)], "resource_id string, job_id long")
    live = ids.filter("job_id = 1")
    plan = job_plan.job_plan(table, ids, live, paused=False)
    assert rows(plan, "resource_id", "action", "job_id", "pause_status", "run_now") == [
        ("a", "CREATE", None, "UNPAUSED", False), ("b", "UPDATE", 1, None, False), ("c", "RECREATE", None, None, True)]
    steps = job_plan.task_plan(table.withColumn("task_config", F.lit('{"file_path": "p", "run_if": "SOMETIMES"}')))
    assert rows(steps, "resource_id", "cleaned_key", "level", "run_if", "task_timeout_seconds") == [
        ("a", "x_1", 0, None, 3600), ("b", "y", 0, None, 3600), ("c", "z", 0, None, 3600)]
