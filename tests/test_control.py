import uuid

import pytest
from pyspark.sql import functions as F

from millrace.plans.control import ControlTable

TWO = """
jobs:
  sales:
    name: Sales ${var.env}
    schedule: {cron: "0 0 2 * * ?"}
    tasks:
      - {task_key: extract, task_type: notebook, file_path: /n}
      - {task_key: load-it, task_type: sql_file, file_path: /f.sql, depends_on: [extract]}
  broken:
    tasks:
      - {task_key: a, task_type: notebook, depends_on: [b]}
"""


@pytest.fixture
def table(spark):
    return ControlTable(spark, f"control_{uuid.uuid4().hex[:8]}").ensure()


def test_a_life_of_a_control_table(spark, rows, table, tmp_path):
    file = tmp_path / "jobs.yaml"
    file.write_text(TWO)
    report = table.load_document(str(file), {"env": "dev"}, user=F.lit("ann"))
    assert report.summary.first().asDict() == {"tasks_loaded": 2, "jobs_loaded": 1, "jobs_failed": 1, "tasks_deleted": 0}
    assert rows(report.problems, "resource_id", "task_key", "reason") == [("broken", "a", "missing_dependency")]
    assert rows(table.tasks("Sales dev"), "task_key", "created_by") == [("extract", "ann"), ("load-it", "ann")]
    assert rows(table.changes()) == [("sales", None, "new")]

    before = table.rows.agg(F.max("updated_timestamp")).first()[0]
    file.write_text(TWO.replace("      - {task_key: extract, task_type: notebook, file_path: /n}\n", "").replace(", depends_on: [extract]", ""))
    report = table.load_document(str(file), {"env": "dev"}, user=F.lit("bob"))
    assert report.summary.first()["tasks_deleted"] == 1
    assert rows(report.actions) == [("delete", 1), ("update", 1)]
    assert rows(table.rows, "task_key", "created_by", "updated_by") == [("load-it", "ann", "bob")]
    assert rows(table.changes(before)) == [("sales", None, "updated")]

    none = spark.createDataFrame([], "job_id long")
    plan = table.plan(none).first()
    assert (plan.action, plan.display_name, plan.pause_status, plan.run_now) == ("CREATE", "Sales dev", "UNPAUSED", False)
    table.store_ids(spark.createDataFrame([("sales", "Sales dev", 7)], "resource_id string, job_name string, job_id long"))
    assert table.plan(spark.createDataFrame([(7,)], "job_id long"), only=table.resources()).first().action == "UPDATE"
    step = table.task_plan(F.lit("w")).first()
    assert (step.cleaned_key, step.level, step.warehouse_id, step.reasons) == ("load_it", 0, "w", [])


def test_a_folder_loads_whole_or_not_at_all(rows, table, tmp_path):
    (tmp_path / "a.yaml").write_text(TWO)
    table.load_folder(str(tmp_path), {"env": "dev"})
    assert table.rows.count() == 0
    (tmp_path / "a.yaml").write_text(TWO.split("  broken:")[0])
    report = table.load_folder(str(tmp_path), {"env": "dev"})
    assert report.summary.first()["tasks_loaded"] == 2 and table.rows.count() == 2
    assert rows(table.resources()) == [("sales",)]


def test_keyed_changes(spark, rows, table):
    table.insert(spark.createDataFrame([("r", "r", "t", "notebook")], "resource_id string, job_name string, task_key string, task_type string"))
    assert rows(table.rows, "resource_id", "disabled") == [("r", False)]
    table.update(F.col("resource_id") == "r", {"disabled": F.lit(True)})
    assert rows(table.rows, "resource_id", "disabled") == [("r", True)]
    row = table.rows.first()
    assert row.created_timestamp < row.updated_timestamp
    with pytest.raises(ValueError):
        ControlTable(spark, "")


def test_a_rejected_load_does_not_write(spark, rows, table, tmp_path, monkeypatch):
    from millrace.plans import control

    (tmp_path / "a.yaml").write_text(TWO)
    monkeypatch.setattr(control, "overwrite", lambda *a: pytest.fail("written"))
    report = table.load_folder(str(tmp_path), {"env": "dev"})
    assert report.summary.first().asDict() == {"tasks_loaded": 0, "jobs_loaded": 0, "jobs_failed": 1, "tasks_deleted": 0}
    assert report.problems.count() == 1 and report.actions.count() == 0


def test_an_id_twice_in_one_document(spark, rows, table, tmp_path):
    job = "  {id}:\n    tasks:\n      - {{task_key: {key}, task_type: notebook, file_path: p}}\n"
    (tmp_path / "a.yaml").write_text("jobs:\n" + job.format(id="x", key="a") + job.format(id="y", key="a") + job.format(id="x", key="b"))
    (tmp_path / "none.yaml").write_text("")
    report = table.load_document(str(tmp_path))
    problems = report.problems.select(F.element_at(F.split("path", "/"), -1).alias("file"), "resource_id", "reason").distinct()
    assert rows(problems) == [("a.yaml", "x", "repeated_resource_id"), ("none.yaml", None, "empty_document")]
    assert rows(table.resources()) == [("y",)]


def test_values_and_keys_that_cannot_be_meant(rows, table, tmp_path):
    (tmp_path / "a.yaml").write_text("""
jobs:
  slow: {timeout_seconds: soon, tasks: [{task_key: a, task_type: notebook, file_path: p}]}
  late: {tasks: [{task_key: a, task_type: notebook, file_path: p, timeout_seconds: [1]}]}
  same: {tasks: [{task_key: a-b, task_type: notebook, file_path: p}, {task_key: a_b, task_type: notebook, file_path: p}]}
  good: {timeout_seconds: "60", tasks: [{task_key: a, task_type: notebook, file_path: p, timeout_seconds: 5}]}
""")
    report = table.load_document(str(tmp_path))
    assert rows(report.problems, "resource_id", "task_key", "reason") == [
        ("late", "a", "bad_value:timeout_seconds"), ("same", "a-b", "cleaned_key_collision"),
        ("same", "a_b", "cleaned_key_collision"), ("slow", "a", "bad_value:timeout_seconds")]
    assert rows(table.resources()) == [("good",)]


def test_polls(spark, rows, table, tmp_path):
    one = "jobs:\n  {id}:\n    tasks:\n      - {{task_key: {key}, task_type: notebook, file_path: p}}\n"
    (tmp_path / "a.yaml").write_text(one.format(id="a", key="t"))
    none = spark.createDataFrame([], "job_id long")
    names = lambda df: sorted((r.path.split("/")[-1], r.action) for r in df.collect())
    first = table.sync(str(tmp_path), none)
    assert names(first.files) == [("a.yaml", "new")] and first.report.summary.first()["jobs_loaded"] == 1
    assert rows(first.plan, "resource_id", "action") == [("a", "CREATE")]
    # Nothing new: nothing is loaded and no job is planned.
    second = table.sync(str(tmp_path), none, first.listing, first.watermark)
    assert second.files.count() == 0 and second.report is None
    assert second.changes.count() == 0 and second.plan.count() == 0
    # A change of the table alone concerns its own job; a new file concerns all of them.
    table.insert(spark.createDataFrame([("z", "z", "t", "notebook")], "resource_id string, job_name string, task_key string, task_type string"))
    third = table.sync(str(tmp_path), none, second.listing, second.watermark)
    assert third.report is None and rows(third.plan, "resource_id") == [("z",)]
    (tmp_path / "b.yaml").write_text("jobs: [")
    fourth = table.sync(str(tmp_path), none, third.listing, third.watermark)
    assert names(fourth.files) == [("b.yaml", "new")]
    assert rows(fourth.report.problems, "reason") == [("invalid_document",)]
    assert rows(fourth.plan, "resource_id") == [("a",), ("z",)]
