"""Catalog tables made from the test tables: created, replaced, appended to, streamed, ingested.

Every query works on tables of names of its own, which nothing else reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions.temporal import at as moment
from millrace.plans.tasks import Ingestion, ingest, ingest_then_validate
from millrace.schemas import CONTROL
from millrace.sinks import tables as sinks
from millrace.sources import tables as sources
from millrace.sources.staging import scratch_path
from millrace.streaming import flows
from millrace.workload import at, plain, table

AS_OF = "2024-06-01 00:00:00"
REGIONS = [(0, "south"), (1, "west"), (2, "east"), (3, None)]


def _name(label):
    return f"{label}_{uuid.uuid4().hex}"


def literal_rows(spark, d):
    """Nations with the name that a literal table gives their region."""
    regions = sources.rows(spark, REGIONS, "n_regionkey bigint, side string")
    return table(spark, d, "nation").select("n_nationkey", "n_regionkey").join(regions, "n_regionkey", "left")


def scan_or_sample(spark, d):
    """The first reading finds no table and saves the customers as one; the second finds it."""
    name, customers = _name("customers"), table(spark, d, "customer")
    first = sources.scan_or_sample(spark, name, customers)
    second = sources.scan_or_sample(spark, name, customers.limit(0))
    return first.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("first")).join(
        second.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("second")), "c_mktsegment")


def created_with_defaults(spark, d):
    """Labelled documents inserted into a control table without the columns that have defaults."""
    name = _name("control")
    sinks.create_control_table(spark, name)
    sinks.create_control_table(spark, name)
    labelled = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("resource_id"), F.lit("t").alias("task_key"))
    labelled.createOrReplaceTempView(f"{name}_rows")
    spark.sql(f"INSERT INTO {name} (resource_id, task_key) SELECT resource_id, task_key FROM {name}_rows")
    found = spark.table(name)
    recent = F.col("created_timestamp") > F.current_timestamp() - F.expr("INTERVAL 1 DAY")
    return found.select("resource_id", "disabled", "task_type", recent.alias("stamped"), F.lit(len(CONTROL)).alias("columns"))


def replaced_table(spark, d):
    """A table of open orders, replaced by one of orders that are done."""
    name, orders = _name("orders"), table(spark, d, "orders")
    for status in ("O", "F"):
        sinks.replace_table(orders.filter(F.col("o_orderstatus") == status), name)
    return spark.table(name)


def created_once(spark, d):
    """The second of two tables of one name is not made."""
    name, orders = _name("orders"), table(spark, d, "orders")
    for status in ("O", "F"):
        sinks.create_table_as(orders.filter(F.col("o_orderstatus") == status), name)
    return spark.table(name)


def write_modes(spark, d):
    """Suppliers written by every mode in turn; the appended ones bring a column."""
    name, suppliers = _name("suppliers"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    low, high = F.col("s_nationkey") < 10, F.col("s_nationkey") >= 10
    sinks.write_table(suppliers, name)
    sinks.write_table(suppliers.filter(low), name, "overwrite")
    sinks.write_table(suppliers, name, "ignore")
    sinks.write_table(suppliers.filter(high).withColumn("origin", F.lit("appended")), name, "append")
    return spark.table(name)


def view_rows(spark, d):
    """Parts of a view, by SQL."""
    name = _name("parts")
    sinks.temp_view(table(spark, d, "part").filter("p_size > 25"), name)
    return spark.sql(f"SELECT p_type, count(*) AS parts FROM {name} GROUP BY p_type")


def stream_table_updates(spark, d):
    """A table's rows, then those added to it, as a stream that is started twice."""
    name, events = _name("events"), table(spark, d, "events").select("event_id", "user_id")
    target, checkpoint = scratch_path(spark, "updates"), scratch_path(spark, "updates-checkpoint")
    for number in range(3):
        part = events.filter(F.pmod("event_id", F.lit(3)) == number)
        part.write.mode("append").saveAsTable(name)
        double = lambda df: df.withColumn("twice", F.col("event_id") * 2)
        flows.append_flow(flows.table_updates(spark, name), double, target, checkpoint).awaitTermination()
    return spark.read.parquet(target)


def _task(mode, source, target):
    return Ingestion.of("customer_ingestion", {
        "catalog": "spark_catalog", "schema": "default", "source_table": source, "target_table": target, "write_mode": mode,
    })


def _customers(spark, d, mode):
    """Customers of one nation are in the target; those of a segment of two others are ingested."""
    source, target = _name("bronze"), _name("silver")
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    options = {"keep": ("c_mktsegment", "BUILDING"), "name_parts": ("c_name", "c_mktsegment")}
    ingest(spark, _task("overwrite", _name("first"), target), customers.filter("c_nationkey = 1"), moment(AS_OF), **options)
    return _task(mode, source, target), customers.filter("c_nationkey IN (2, 3)"), options


def _ingested(spark, d, mode):
    task, sample, options = _customers(spark, d, mode)
    ingest(spark, task, sample, moment(AS_OF), **options)
    return plain(spark.table(task.target).drop("ingestion_timestamp"))


def ingest_overwrite(spark, d):
    return _ingested(spark, d, "overwrite")


def ingest_append(spark, d):
    return _ingested(spark, d, "append")


def _validated(spark, d, mode):
    task, sample, options = _customers(spark, d, mode)
    return ingest_then_validate(spark, task, sample, at(AS_OF), **options)


def validate_overwrite(spark, d):
    return _validated(spark, d, "overwrite")


def validate_append(spark, d):
    return _validated(spark, d, "append")


QUERIES = {
    f.__name__: f
    for f in (
        literal_rows, scan_or_sample, created_with_defaults, replaced_table, created_once, write_modes, view_rows,
        stream_table_updates, ingest_overwrite, ingest_append, validate_overwrite, validate_append,
    )
}

_INGESTED = """
    SELECT c_custkey, c_name, c_mktsegment, c_nationkey, 'customer_ingestion' AS task_key,
           c_name || ' ' || c_mktsegment AS full_name
    FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN ({nations})"""
_VALIDATED = """
    SELECT 'data_validation' AS validation_type, 'SUCCESS' AS status, count(*) FILTER (WHERE c_nationkey > 1) AS rows_read,
           count(*) FILTER (WHERE c_nationkey > 1 AND c_mktsegment = 'BUILDING') AS rows_kept,
           count(*) FILTER (WHERE c_nationkey IN ({nations}) AND c_mktsegment = 'BUILDING') AS rows_in_target,
           TIMESTAMP '2024-06-01 00:00:00' AS validation_timestamp
    FROM customer WHERE c_nationkey IN (1, 2, 3)"""

SQL = {
    "literal_rows": """
        SELECT n_nationkey, n_regionkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' WHEN 2 THEN 'east' END AS side
        FROM nation""",
    "scan_or_sample": "SELECT c_mktsegment, count(*) AS first, count(*) AS second FROM customer GROUP BY 1",
    "created_with_defaults": """
        SELECT CAST(doc_id AS VARCHAR) AS resource_id, false AS disabled, CAST(NULL AS VARCHAR) AS task_type, true AS stamped,
               12 AS columns FROM labels""",
    "replaced_table": "SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "created_once": "SELECT * FROM orders WHERE o_orderstatus = 'O'",
    "write_modes": "SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey >= 10 THEN 'appended' END AS origin FROM supplier",
    "view_rows": "SELECT p_type, count(*) AS parts FROM part WHERE p_size > 25 GROUP BY 1",
    "stream_table_updates": "SELECT event_id, user_id, event_id * 2 AS twice FROM events",
    "ingest_overwrite": _INGESTED.format(nations="2, 3"),
    "ingest_append": _INGESTED.format(nations="1, 2, 3"),
    "validate_overwrite": _VALIDATED.format(nations="2, 3"),
    "validate_append": _VALIDATED.format(nations="1, 2, 3"),
}
