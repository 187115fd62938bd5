import json

from pyspark.sql import functions as F

from millrace.functions import json as j
from millrace.operators import settings as s


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("v")).first()["v"]


def test_states(spark):
    texts = ['{"a":1}', "[1]", "nope", None, "12", "null", ""]
    states = [one(spark, t, j.json_state(F.col("t"))) for t in texts]
    assert states == ["object", "array", "broken", "missing", "scalar", "null", "broken"]


def test_dependencies(spark):
    texts = ['["a","b"]', "[]", None, "null", '{"a":1}', "[1]", '["a", null]', "[[\"a\"]]", "oops"]
    lists = [one(spark, t, j.parse_dependencies(F.col("t"))) for t in texts]
    assert lists == [["a", "b"], [], [], [], None, None, None, None, None]


def test_settings_keep_types_and_nesting(spark):
    job = {
        "name": "x", "description": "d", "timeout_seconds": 60, "queue": {"enabled": True},
        "environments": [{"environment_key": "e"}], "tags": None, "tasks": [1],
    }
    text = one(spark, json.dumps(job), s.job_settings(j.parse_object(F.col("t"))))
    assert json.loads(text) == {
        "description": "d", "timeout_seconds": 60, "queue": {"enabled": True},
        "_job_environments": [{"environment_key": "e"}], "tags": None,
    }
    assert one(spark, "{}", s.job_settings(j.parse_object(F.col("t")))) == "{}"


def test_task_settings_drop_columns_of_their_own(spark):
    task = {"task_key": "a", "task_type": "sql_file", "depends_on": [], "disabled": True, "file_path": "p", "n": 1.5}
    text = one(spark, json.dumps(task), s.task_settings(j.parse_object(F.col("t"))))
    assert json.loads(text) == {"file_path": "p", "n": 1.5}


def test_parameters(spark):
    kinds = spark.createDataFrame(
        [("notebook", '{"a": 1, "b": true, "c": null}'), ("python_wheel", '{"a": 1, "b": "x"}'), ("spark_jar", '["x", 2]'),
         ("python_wheel", None), ("sql_query", None), ("sql_file", '"text"')], "k string, p string",
    )
    texts = [r[0] for r in kinds.select(s.normalised_parameters(F.col("k"), F.col("p"))).collect()]
    assert texts == ['{"a":"1","b":"true","c":null}', '["1","x"]', '["x","2"]', "[]", "{}", "{}"]


def test_defaults(spark):
    jobs = spark.createDataFrame([("{}",), ('{"timeout_seconds": 5, "queue": {"enabled": true}}',), ("broken",), (None,)], "job_config string")
    got = s.with_job_settings(jobs).select("timeout_seconds", "max_concurrent_runs", "queue").collect()
    assert [tuple(r) for r in got] == [(7200, 1, None), (5, 1, '{"enabled":true}'), (7200, 1, None), (7200, 1, None)]


def test_pause_status(spark):
    cases = [
        (True, True, None, True, "PAUSED"), (True, True, None, False, "UNPAUSED"), (True, True, "UNPAUSED", True, "UNPAUSED"),
        (False, True, None, True, None), (False, True, "PAUSED", False, "PAUSED"), (True, False, None, True, None),
    ]
    df = spark.createDataFrame(cases, "new boolean, has boolean, explicit string, paused boolean, expected string")
    got = df.withColumn("got", s.pause_status(*map(F.col, ["new", "has", "explicit", "paused"])))
    assert got.filter(~F.col("got").eqNullSafe(F.col("expected"))).count() == 0


def test_placeholders_and_domains(spark):
    df = spark.createDataFrame([("Your-Warehouse-ID",), ("your_warehouse_id",), ("w1",), ("",), (None,)], "w string")
    assert [r[0] for r in df.select(s.without_placeholder(F.col("w"), F.lit("d"))).collect()] == ["d", "d", "w1", "d", "d"]
    modes = spark.createDataFrame([("UI_LOCKED",), ("EDITABLE",), ("other",), (None,)], "m string")
    assert [r[0] for r in modes.select(s.edit_mode(F.col("m"))).collect()] == ["UI_LOCKED", "EDITABLE", "EDITABLE", "UI_LOCKED"]
    assert [r[0] for r in modes.select(s.run_condition(F.col("m"))).collect()] == [None] * 4
