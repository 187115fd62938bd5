"""Merges over orders: a snapshot up to one date, and a source that overlaps it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import merge as m
from millrace.operators.ranking import newest_per_key
from millrace.plans.sales import incremental_load as load
from millrace.sinks import buckets, partitions
from millrace.sinks.partitions import merge_partitions
from millrace.sources.staging import scratch_path
from millrace.workload import at, plain, table
from millrace.workload.relational import orders_bronze

AS_OF = "2002-01-01 00:00:00"
LOADED_UNTIL = "2000-01-01"
SOURCE_FROM = "1998-01-01"


def _target(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderdate") < at(LOADED_UNTIL))


def _source(spark, d):
    recent = table(spark, d, "orders").filter(F.col("o_orderdate") >= at(SOURCE_FROM))
    return recent.withColumn("o_totalprice", F.col("o_totalprice") * 1.1)


def _partial_source(spark, d):
    return _source(spark, d).filter((F.col("o_orderstatus") != "P") & (F.col("o_totalprice") > 200000))


def upsert(spark, d):
    return m.upsert(
        _target(spark, d), _source(spark, d), ["o_orderkey"], update=["o_totalprice", "o_orderstatus"], with_action=True
    )


def upsert_full_join(spark, d):
    return m.upsert(
        _target(spark, d), _source(spark, d), ["o_orderkey"], update=["o_totalprice"], with_action=True, how="full"
    )


def conditional_upsert(spark, d):
    orders = _target(spark, d).select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("updated_at"),
    )
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linestatus").alias("status"),
        F.col("l_shipdate").alias("updated_at"),
    )
    shipped = newest_per_key(lines, ["order_id"], "updated_at", [F.col("status")])
    return m.upsert_newer(orders, shipped, ["order_id"], with_action=True)


def incremental_window(spark, d):
    events = table(spark, d, "events")
    loaded = events.filter(F.col("ts") < at("2024-01-21")).select(F.col("ts").alias("updated_at"))
    return m.incremental_window(events, loaded, "ts", "updated_at").select("event_id", "ts", "user_id")


def incremental_load(spark, d):
    bronze = orders_bronze(spark, d)
    silver = bronze.filter(F.col("processed_at") < at(LOADED_UNTIL)).select(
        "*", (F.col("processed_at") - F.expr("INTERVAL 30 DAYS")).alias("updated_at")
    )
    return plain(load(silver, bronze, at(AS_OF)))


def incremental_load_bucketed(spark, d):
    """The same load into a table bucketed by order, which is not shuffled."""
    bronze = orders_bronze(spark, d)
    silver = bronze.filter(F.col("processed_at") < at(LOADED_UNTIL)).select(
        "*", (F.col("processed_at") - F.expr("INTERVAL 30 DAYS")).alias("updated_at")
    )
    name = f"silver_{uuid.uuid4().hex}"
    buckets.write_bucketed(silver, name, ["order_id"], 16)
    merged = lambda target: load(target, bronze, at(AS_OF), how="full", complete=True)
    buckets.replace_bucketed(spark, name, merged, ["order_id"], 16)
    return plain(spark.table(name))


def _yearly(orders):
    """Orders with the year they are kept under; some have none."""
    return orders.withColumn("year", F.when(F.col("o_orderkey") % 17 != 0, F.year("o_orderdate")))


def reconcile_partitions(spark, d):
    """A table partitioned by year takes a snapshot of some years; what those years lack goes."""
    target, path = _yearly(_target(spark, d)), scratch_path(spark, "orders")
    target.write.partitionBy("year").parquet(path)
    source = _yearly(_partial_source(spark, d))
    merge_partitions(spark, path, target.schema, source, ["year", "o_orderkey"], ["year"], delete=["year"])
    return spark.read.schema(target.schema).parquet(path)


def update_partitions(spark, d):
    """Open orders of a table kept by year get another price; years without any are left alone."""
    orders, path = _yearly(table(spark, d, "orders")), scratch_path(spark, "orders")
    orders.write.partitionBy("year").parquet(path)
    raised = {"o_totalprice": F.col("o_totalprice") + 1}
    open_late = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") >= at("1999-06-01"))
    partitions.update_partitions(spark, path, orders.schema, open_late, raised, ["year"])
    return spark.read.schema(orders.schema).parquet(path)


def scoped_delete(spark, d):
    source = table(spark, d, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000))
    return m.scoped_delete(table(spark, d, "orders"), source, ["o_custkey", "o_orderkey"], ["o_custkey"])


def _control(df, user):
    """Orders as control rows: customer is the job, order the task."""
    return df.select(
        F.col("o_custkey").alias("resource_id"),
        F.col("o_orderkey").alias("task_key"),
        F.col("o_totalprice").alias("amount"),
        F.lit(user).alias("created_by"),
        F.col("o_orderdate").alias("created_timestamp"),
        F.lit(user).alias("updated_by"),
        F.col("o_orderdate").alias("updated_timestamp"),
    )


def _reconciled(spark, d, scope, **options):
    source = _partial_source(spark, d).select(
        F.col("o_custkey").alias("resource_id"), F.col("o_orderkey").alias("task_key"), F.col("o_totalprice").alias("amount")
    )
    return m.reconcile(
        _control(_target(spark, d), "first"), source, ["resource_id", "task_key"], scope,
        audit=m.Audit(at(AS_OF), F.lit("second")), **options,
    )


def reconcile(spark, d):
    return _reconciled(spark, d, ["resource_id"])


def reconcile_all(spark, d):
    return _reconciled(spark, d, "all", how="left")


def reconcile_actions(spark, d):
    return m.action_counts(_reconciled(spark, d, ["resource_id"], keep_deleted=True, with_action=True))


def upsert_ids(spark, d):
    ids = table(spark, d, "labels").select(
        F.col("doc_id").alias("resource_id"), F.col("quality").cast("bigint").alias("job_id"), F.lit("old").alias("job_name"),
        F.lit("first").alias("created_by"), at("2001-01-01 00:00:00").alias("created_timestamp"),
        F.lit("first").alias("updated_by"), at("2001-01-01 00:00:00").alias("updated_timestamp"),
    )
    assigned = table(spark, d, "documents").select(
        F.col("doc_id").alias("resource_id"), F.col("source").alias("job_name"), F.col("n_chars").alias("job_id")
    )
    return m.upsert_ids(ids, assigned, m.Audit(at(AS_OF), F.lit("second")), how="full")


def keyed_insert_update(spark, d):
    orders = table(spark, d, "orders")
    old = orders.filter(F.col("o_orderdate") < at(LOADED_UNTIL))
    new = orders.filter(F.col("o_orderdate") >= at(LOADED_UNTIL)).drop("o_orderpriority")
    grown = m.insert_rows(old, new, {"o_orderpriority": F.lit("3-MEDIUM")})
    return m.update_where(
        grown, F.col("o_orderstatus") == "P",
        {"o_orderpriority": F.lit("1-URGENT"), "o_totalprice": F.col("o_totalprice") + 1},
    )


QUERIES = {
    "upsert": upsert,
    "upsert_full_join": upsert_full_join,
    "conditional_upsert": conditional_upsert,
    "incremental_window": incremental_window,
    "incremental_load": incremental_load,
    "incremental_load_bucketed": incremental_load_bucketed,
    "reconcile_partitions": reconcile_partitions,
    "update_partitions": update_partitions,
    "scoped_delete": scoped_delete,
    "reconcile": reconcile,
    "reconcile_all": reconcile_all,
    "reconcile_actions": reconcile_actions,
    "upsert_ids": upsert_ids,
    "keyed_insert_update": keyed_insert_update,
}

_SIDES = """
WITH t AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
     s AS (SELECT * REPLACE (o_totalprice * 1.1::DOUBLE AS o_totalprice) FROM orders
           WHERE o_orderdate >= TIMESTAMP '1998-01-01')
"""
_UPSERT = _SIDES + """
SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(t.o_custkey, s.o_custkey) AS o_custkey,
       coalesce(s.o_orderstatus, t.o_orderstatus) AS o_orderstatus,
       coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice,
       coalesce(t.o_orderdate, s.o_orderdate) AS o_orderdate,
       coalesce(t.o_orderpriority, s.o_orderpriority) AS o_orderpriority,
       CASE WHEN t.o_orderkey IS NULL THEN 'insert' WHEN s.o_orderkey IS NULL THEN 'keep' ELSE 'update' END AS action
FROM t FULL JOIN s ON t.o_orderkey = s.o_orderkey
"""
_RECONCILED = """
WITH t AS (SELECT o_custkey AS resource_id, o_orderkey AS task_key, o_totalprice AS amount, o_orderdate AS at
           FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
     s AS (SELECT o_custkey AS resource_id, o_orderkey AS task_key, o_totalprice * 1.1::DOUBLE AS amount FROM orders
           WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P'
             AND o_totalprice * 1.1::DOUBLE > 200000),
     a AS (SELECT 'insert' AS action, s.resource_id, s.task_key, s.amount, 'second' AS created_by,
                  TIMESTAMP '2002-01-01' AS created_timestamp, 'second' AS updated_by,
                  TIMESTAMP '2002-01-01' AS updated_timestamp
           FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.resource_id = s.resource_id AND t.task_key = s.task_key)
           UNION ALL
           SELECT 'update', t.resource_id, t.task_key, s.amount, 'first', t.at, 'second', TIMESTAMP '2002-01-01'
           FROM t JOIN s ON t.resource_id = s.resource_id AND t.task_key = s.task_key
           UNION ALL
           SELECT CASE WHEN {gone} THEN 'delete' ELSE 'keep' END, t.resource_id, t.task_key, t.amount,
                  'first', t.at, 'first', t.at
           FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE t.resource_id = s.resource_id AND t.task_key = s.task_key))
"""
_TOUCHED = _RECONCILED.format(gone="t.resource_id IN (SELECT resource_id FROM s)")

SQL = {
    "upsert": _UPSERT,
    "upsert_full_join": _UPSERT.replace(
        "coalesce(s.o_orderstatus, t.o_orderstatus)", "coalesce(t.o_orderstatus, s.o_orderstatus)"
    ),
    "conditional_upsert": """
        WITH t AS (SELECT o_orderkey AS order_id, o_orderstatus AS status, o_orderdate AS updated_at FROM orders
                   WHERE o_orderdate < TIMESTAMP '2000-01-01'),
             s AS (SELECT * FROM (SELECT l_orderkey AS order_id, l_linestatus AS status, l_shipdate AS updated_at,
                          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linestatus) AS rn
                   FROM lineitem) WHERE rn = 1)
        SELECT coalesce(t.order_id, s.order_id) AS order_id,
               CASE WHEN t.order_id IS NULL OR t.updated_at < s.updated_at THEN s.status ELSE t.status END AS status,
               CASE WHEN t.order_id IS NULL OR t.updated_at < s.updated_at THEN s.updated_at ELSE t.updated_at END
                   AS updated_at,
               CASE WHEN t.order_id IS NULL THEN 'insert' WHEN t.updated_at < s.updated_at THEN 'update'
                    ELSE 'keep' END AS action
        FROM t FULL JOIN s ON t.order_id = s.order_id""",
    "incremental_window": """
        SELECT event_id, ts, user_id FROM events
        WHERE ts >= coalesce((SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-21'), TIMESTAMP '1970-01-01')""",
    "incremental_load": """
        WITH b AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
                          o_orderdate AS order_date, o_totalprice AS revenue, o_orderpriority AS status,
                          o_orderdate AS processed_at FROM orders),
             t AS (SELECT *, processed_at - INTERVAL 30 DAYS AS updated_at FROM b
                   WHERE processed_at < TIMESTAMP '2000-01-01'),
             s AS (SELECT * REPLACE (upper(status) AS status, date_trunc('day', order_date) AS order_date),
                          TIMESTAMP '2002-01-01' AS updated_at
                   FROM b WHERE processed_at >= (SELECT max(updated_at) FROM t) AND revenue > 0)
        SELECT coalesce(t.order_id, s.order_id) AS order_id, coalesce(s.customer_id, t.customer_id) AS customer_id,
               coalesce(s.order_date, t.order_date) AS order_date, coalesce(s.revenue, t.revenue) AS revenue,
               coalesce(s.status, t.status) AS status, coalesce(t.processed_at, s.processed_at) AS processed_at,
               coalesce(s.updated_at, t.updated_at) AS updated_at
        FROM t FULL JOIN s ON t.order_id = s.order_id""",
    "scoped_delete": """
        WITH s AS (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)
        SELECT * FROM orders t
        WHERE NOT (t.o_custkey IN (SELECT o_custkey FROM s)
                   AND NOT EXISTS (SELECT 1 FROM s WHERE s.o_custkey = t.o_custkey AND s.o_orderkey = t.o_orderkey))""",
    "reconcile": _TOUCHED + "SELECT * EXCLUDE (action) FROM a WHERE action <> 'delete'",
    "reconcile_all": _RECONCILED.format(gone="true") + "SELECT * EXCLUDE (action) FROM a WHERE action <> 'delete'",
    "reconcile_actions": _TOUCHED + "SELECT action, count(*) AS rows FROM a GROUP BY action",
    "upsert_ids": """
        SELECT d.doc_id AS resource_id, d.n_chars AS job_id, d.source AS job_name,
               CASE WHEN l.doc_id IS NULL THEN 'second' ELSE 'first' END AS created_by,
               CASE WHEN l.doc_id IS NULL THEN TIMESTAMP '2002-01-01' ELSE TIMESTAMP '2001-01-01' END
                   AS created_timestamp,
               'second' AS updated_by, TIMESTAMP '2002-01-01' AS updated_timestamp
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "keyed_insert_update": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate,
               CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
               CASE WHEN o_orderstatus = 'P' THEN '1-URGENT' WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN '3-MEDIUM'
                    ELSE o_orderpriority END AS o_orderpriority
        FROM orders""",
}

SQL["incremental_load_bucketed"] = SQL["incremental_load"]
SQL["reconcile_partitions"] = """
    WITH y AS (SELECT *, CAST(CASE WHEN o_orderkey % 17 <> 0 THEN year(o_orderdate) END AS INTEGER) AS year FROM orders),
         t AS (SELECT * FROM y WHERE o_orderdate < TIMESTAMP '2000-01-01'),
         s AS (SELECT * REPLACE (o_totalprice * 1.1::DOUBLE AS o_totalprice) FROM y
               WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P' AND o_totalprice * 1.1::DOUBLE > 200000)
    SELECT * FROM s
    UNION ALL
    SELECT * FROM t WHERE year IS NULL OR year NOT IN (SELECT year FROM s WHERE year IS NOT NULL)"""
SQL["update_partitions"] = """
    SELECT * REPLACE (CASE WHEN o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1999-06-01' THEN o_totalprice + 1
                           ELSE o_totalprice END AS o_totalprice),
           CAST(CASE WHEN o_orderkey % 17 <> 0 THEN year(o_orderdate) END AS INTEGER) AS year FROM orders"""
