"""What the plans must and must not contain, and what the sources must not call."""

import contextlib
import io
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from millrace.operators import merge as m
from millrace.operators.ranking import first_per_key
from millrace.sources.staging import stage

ROOT = Path(__file__).resolve().parents[1]
FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize(
    "name",
    [
        name
        for name, query in contract.queries().items()
        if query.__module__.startswith("millrace.workload") and not name.startswith("stream_")
    ],
)
def test_no_query_pairs_all_rows(spark, name):
    text = plan(contract.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_one_row_per_key_leaves_each_map_task(spark):
    text = plan(first_per_key(spark.read.parquet(f"{FOLDER}/orders.parquet"), ["o_custkey"], [F.col("o_orderdate")]))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(contract.queries()["positive_balance"](spark, FOLDER))
    assert "GreaterThan(c_acctbal,0.0)" in text and "ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double>" in text
    text = plan(contract.queries()["daily_as_of"](spark, FOLDER))
    assert "GreaterThanOrEqual(o_orderdate,1998-10-03T00:00)" in text and "LessThan(o_orderdate,1998-10-04T00:00)" in text
    assert "GreaterThan(l_extendedprice,0.0)" in plan(contract.queries()["sales_daily"](spark, FOLDER))
    assert "GreaterThanOrEqual(ts,ScalarSubquery" in plan(contract.queries()["incremental_window"](spark, FOLDER))


def test_a_small_increment_does_not_shuffle_the_target(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    source = stage(spark.createDataFrame([(1, 1.0)], "o_orderkey long, o_totalprice double"), "source")
    text = plan(m.upsert(orders, source, ["o_orderkey"], update=["o_totalprice"]))
    assert "SortMergeJoin" not in text.split("\n\n\n")[0]
    assert "ReadSchema: struct<o_orderkey:bigint>" in text  # the second pass reads keys alone


def test_a_full_merge_shuffles_each_side_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
        text = plan(m.upsert(orders, orders, ["o_orderkey"], update=["o_totalprice"], how="full"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.split("\n\n\n")[0].count("Exchange") == 2


def test_sources_keep_to_the_rules():
    for path in [*ROOT.glob("millrace/**/*.py"), ROOT / "__spark_entry__.py"]:
        if path.parent.name == "llm":
            continue
        text = path.read_text()
        for word in ("localCheckpoint", "crossJoin", ".rdd", "F.udf", "broadcast(", "toPandas", "_jdf", "_jvm"):
            assert word not in text, f"{word} in {path}"


def test_functions_of_tasks_need_no_package_on_executors(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from millrace.operators import graph
    from millrace.sources import documents

    for number, function in enumerate((graph._levels_of, graph._cycles_of, documents._yaml_jobs)):
        (tmp_path / f"{number}").write_bytes(cloudpickle.dumps(function))
    code = (
        "import pickle, sys, pyspark.cloudpickle\n"
        f"for n in range(3): pickle.load(open(f'{tmp_path}/{{n}}', 'rb'))\n"
        "assert not any(m.startswith('millrace') for m in sys.modules)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
