import pytest
from pyspark.sql import functions as F

from millrace.functions import text as x

# Raw keys and what they become.
KEYS = [
    ("test-source", "test_source"), ("test@source", "test_source"), ("test.source", "test_source"),
    ("test-source.name", "test_source_name"), ("test___source", "test_source"), ("__test__", "test"),
    ("@test_source", "task_test_source"), ("-test_source", "task_test_source"), (".test_source", "task_test_source"),
    ("123", "123"), ("", ""), ("@", ""), ("@@@", ""), ("a-b", "a_b"), ("a.b", "a_b"), ("élan vital", "lan_vital"),
    ("日本-x", "x"), ("_x", "x"), ("a\nb", "a_b"), (" a", "task_a"),
]


def test_clean_key(spark):
    df = spark.createDataFrame(KEYS, "raw string, expected string")
    wrong = df.withColumn("got", x.clean_key(F.col("raw"))).filter("got <> expected OR got IS NULL").collect()
    assert wrong == []


def filled(spark, text, variables):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(x.fill_template(F.col("t"), variables).alias("f"), x.undefined_variables(F.col("t"), variables).alias("u"))
    return tuple(row.first())


@pytest.mark.parametrize("as_map", [False, True])
@pytest.mark.parametrize(
    "text, variables, expected, missing",
    [
        ("SELECT * FROM ${var.catalog}.${var.env}_data", {"env": "prod", "catalog": "bronze"}, "SELECT * FROM bronze.prod_data", []),
        ("${var.a}${var.a}", {"a": "x"}, "xx", []),
        ("no reference", {"a": "x"}, "no reference", []),
        ("${env} stays", {"env": "x"}, "${env} stays", []),
        ("${var.9bad} stays", {"a": "x"}, "${var.9bad} stays", []),
        ("${var.b} ${var.a} ${var.b}", {"a": "x"}, None, ["b"]),
        ('say "${var.a}"', {"a": 'q"uote'}, 'say "q"uote"', []),
        ("${var.flag}", {"flag": True}, "True", []),
        ("$${var.a}{var.b}", {"a": "", "b": "y"}, "${var.b}", []),
        ("${var.my-var} stays", {"my-var": "x"}, "${var.my-var} stays", []),
        ("${var.a}-${var.b}", {"a": "${var.b}", "b": "y"}, "${var.b}-y", []),
        ("${var.a}", {}, "${var.a}", []),
        ("", {"a": "x"}, "", []),
    ],
)
def test_templates(spark, as_map, text, variables, expected, missing):
    given = x.variable_map(variables) if as_map else variables
    assert filled(spark, text, given) == (expected, missing)


def test_null_template(spark):
    assert filled(spark, None, {"a": "x"})[0] is None


def test_commands(spark):
    df = spark.createDataFrame(
        [(["dbt run", " edr x"],), (["dbt run", "rm x"],), ([],), (None,)], "c array<string>"
    )
    assert [r[0] for r in df.select(x.commands_have_prefix(F.col("c"))).collect()] == [True, False, True, None]


def test_display_name(spark):
    df = spark.createDataFrame([(None, "id"), ("name", "id")], "n string, r string")
    assert [r[0] for r in df.select(x.display_name(F.col("n"), F.col("r"), "[p] ")).collect()] == ["[p] id", "[p] name"]
