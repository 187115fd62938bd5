"""Sales, projections, filters, aggregations, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import aggregate, ranking, transform
from millrace.plans.sales import audit_freshness, daily_sales, sales_run, to_silver
from millrace.plans.tasks import ingest_rows, run_query, run_script
from millrace.sources.tables import scan_identifier
from millrace.workload import at, plain, table

AS_OF = "2002-01-01 00:00:00"


def order_lines(spark, d):
    """Bronze sales: one row per order line."""
    # The raw price is compared where it is read; silver compares it again once it is rounded.
    lines = table(spark, d, "lineitem").filter("l_extendedprice > 0").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("revenue"),
        F.lower("o_orderstatus").alias("status"),
        F.col("l_shipdate").alias("processed_at"),
    )


def orders_bronze(spark, d):
    return transform.project(
        table(spark, d, "orders"),
        {
            "order_id": "o_orderkey",
            "customer_id": "o_custkey",
            "order_date": "o_orderdate",
            "revenue": "o_totalprice",
            "status": "o_orderpriority",
            "processed_at": "o_orderdate",
        },
        {"order_id": "string", "customer_id": "string"},
    )


def sales_daily(spark, d):
    return plain(sales_run(order_lines(spark, d), at(AS_OF), done="F").daily)


def daily_as_of(spark, d):
    silver = to_silver(order_lines(spark, d), at(AS_OF))
    return plain(daily_sales(silver, at(AS_OF), day="1998-10-03", done="F"))


_DAILY_SQL = """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS order_date,
       count(*) AS total_orders,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
       CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS total_quantity,
       count(DISTINCT o_custkey) AS unique_customers,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_order_value,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS completed_orders,
       TIMESTAMP '2002-01-01 00:00:00' AS processed_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_extendedprice > 0 {where}
GROUP BY 1
"""


def silver_orders(spark, d):
    return plain(to_silver(orders_bronze(spark, d), at(AS_OF)))


def ingest_customers(spark, d):
    return ingest_rows(
        table(spark, d, "customer"), "customer_ingestion", at(AS_OF), ("c_mktsegment", "BUILDING"), ("c_name", "c_mktsegment")
    )


def freshness(spark, d):
    events = table(spark, d, "events").select(
        F.col("event_type").alias("table_name"), F.col("ts").alias("last_update_time")
    )
    expected = transform.union_all(
        events.select("table_name").distinct(), spark.range(1).select(F.lit("refund").alias("table_name"))
    )
    return audit_freshness(events, at("2024-01-31 12:30:00"), "12", expected)


def quality_check(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    repeated = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).cast("double") / F.sum("n")
    return aggregate.quality_check(counts, "repeated_line_keys", repeated, 0.5, at(AS_OF))


def threshold_status(spark, d):
    orders = table(spark, d, "orders")
    return orders.select("o_orderkey", transform.classify(F.col("o_totalprice"), 250000.0).alias("quality_status"))


def global_max(spark, d):
    return aggregate.latest(table(spark, d, "orders"), "o_orderdate")


def distinct_keys(spark, d):
    return aggregate.distinct_keys(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"])


def row_counts(spark, d):
    names = ["customer", "orders", "lineitem", "events", "documents", "pages", "conversations"]
    counts = [
        aggregate.row_count(table(spark, d, name)).withColumn("table_name", F.lit(name)) for name in names
    ]
    return transform.union_all(*counts)


def newest_per_key(spark, d):
    lines = table(spark, d, "lineitem")
    rest = [F.col(c).desc() for c in lines.columns if c not in ("l_orderkey", "l_linenumber", "l_shipdate")]
    return ranking.newest_per_key(lines, ["l_orderkey", "l_linenumber"], "l_shipdate", rest)


def first_per_group(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return ranking.first_per_key(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


def sorted_keys(spark, d):
    return ranking.sorted_keys(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


def preview(spark, d):
    customers = table(spark, d, "customer")
    return transform.preview(
        customers, ["c_custkey", "c_name", "c_acctbal"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 5
    )


def positive_balance(spark, d):
    kept = transform.present_and_positive(table(spark, d, "customer"), ["c_name"], ["c_acctbal"])
    return kept.select("c_custkey", "c_acctbal")


def newer_events(spark, d):
    return transform.newer_than(table(spark, d, "events"), "ts", "2024-01-15 12:00:00").select("event_id", "ts")


def union_all(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return transform.union_all(customers, suppliers)


def schema_merge(spark, d):
    orders = table(spark, d, "orders")
    old = orders.filter(F.col("o_orderdate") < at("1998-01-01")).drop("o_orderpriority")
    new = orders.filter(F.col("o_orderdate") >= at("1998-01-01"))
    return transform.union_all(old, new, allow_missing=True)


def param_query(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("millrace_orders")
    return run_query(
        spark,
        """SELECT o_orderstatus, count(*) AS orders FROM IDENTIFIER(:source)
           WHERE o_totalprice > CAST(:min_price AS DOUBLE) GROUP BY o_orderstatus""",
        {"source": "millrace_orders", "min_price": 250000},
    )


def sql_script(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("millrace_orders")
    table(spark, d, "customer").createOrReplaceTempView("millrace_customer")
    script = """
        -- one view; then the report
        CREATE OR REPLACE TEMPORARY VIEW millrace_spend AS
        SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend
        FROM millrace_orders GROUP BY o_custkey;

        SELECT c_mktsegment AS segment, count(*) AS customers, 'a;b' AS mark
        FROM millrace_spend JOIN millrace_customer ON o_custkey = c_custkey
        WHERE spend > CAST(:min_spend AS DOUBLE)
        GROUP BY c_mktsegment
    """
    return run_script(spark, script, {"min_spend": "2000000"})


def named_scan(spark, d):
    table(spark, d, "supplier").createOrReplaceTempView("millrace_supplier")
    return scan_identifier(spark, "millrace_supplier").select("s_suppkey", "s_name", "s_nationkey")


QUERIES = {
    "sales_daily": sales_daily,
    "daily_as_of": daily_as_of,
    "silver_orders": silver_orders,
    "ingest_customers": ingest_customers,
    "freshness": freshness,
    "quality_check": quality_check,
    "threshold_status": threshold_status,
    "global_max": global_max,
    "distinct_keys": distinct_keys,
    "row_counts": row_counts,
    "newest_per_key": newest_per_key,
    "first_per_group": first_per_group,
    "sorted_keys": sorted_keys,
    "preview": preview,
    "positive_balance": positive_balance,
    "newer_events": newer_events,
    "union_all": union_all,
    "schema_merge": schema_merge,
    "param_query": param_query,
    "sql_script": sql_script,
    "named_scan": named_scan,
}

SQL = {
    "sales_daily": _DAILY_SQL.format(where=""),
    "daily_as_of": _DAILY_SQL.format(where="AND CAST(o_orderdate AS DATE) = DATE '1998-10-03'"),
    "silver_orders": """
        SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
               strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_totalprice AS revenue,
               upper(o_orderpriority) AS status, o_orderdate AS processed_at,
               TIMESTAMP '2002-01-01 00:00:00' AS updated_at
        FROM orders WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND o_totalprice > 0""",
    "ingest_customers": """
        SELECT *, TIMESTAMP '2002-01-01 00:00:00' AS ingestion_timestamp, 'customer_ingestion' AS task_key,
               c_name || ' ' || c_mktsegment AS full_name
        FROM customer WHERE c_mktsegment = 'BUILDING'""",
    "freshness": """
        WITH expected AS (SELECT DISTINCT event_type AS table_name FROM events UNION ALL SELECT 'refund'),
             newest AS (SELECT event_type AS table_name, max(ts) AS last_update_time FROM events GROUP BY 1),
             aged AS (SELECT table_name, last_update_time, TIMESTAMP '2024-01-31 12:30:00' AS check_time,
                             date_sub('hour', last_update_time, TIMESTAMP '2024-01-31 12:30:00') AS hours_since_update
                      FROM expected LEFT JOIN newest USING (table_name))
        SELECT *, CASE WHEN hours_since_update > 12 THEN 'STALE' WHEN hours_since_update IS NULL THEN 'NO_DATA'
                       ELSE 'FRESH' END AS freshness_status
        FROM aged""",
    "quality_check": """
        WITH counts AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber),
             measured AS (SELECT CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS DOUBLE) / sum(n) AS m FROM counts)
        SELECT TIMESTAMP '2002-01-01 00:00:00' AS check_timestamp, 'repeated_line_keys' AS check_name,
               m AS measured_value, CAST(0.5 AS DOUBLE) AS threshold_value,
               CASE WHEN m <= 0.5 THEN 'PASS' ELSE 'FAIL' END AS quality_status
        FROM measured""",
    "threshold_status": """
        SELECT o_orderkey, CASE WHEN o_totalprice <= 250000 THEN 'PASS' ELSE 'FAIL' END AS quality_status FROM orders""",
    "global_max": "SELECT coalesce(max(o_orderdate), TIMESTAMP '1970-01-01 00:00:00') AS o_orderdate FROM orders",
    "distinct_keys": "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem",
    "row_counts": " UNION ALL ".join(
        f"SELECT count(*) AS row_count, '{n}' AS table_name FROM {n}"
        for n in ["customer", "orders", "lineitem", "events", "documents", "pages", "conversations"]
    ),
    "newest_per_key": """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC,
                         l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn
            FROM lineitem) WHERE rn = 1""",
    "first_per_group": """
        SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM (
            SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
        WHERE rn = 1""",
    "sorted_keys": "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer ORDER BY 1, 2",
    "preview": "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5",
    "positive_balance": "SELECT c_custkey, c_acctbal FROM customer WHERE c_name IS NOT NULL AND c_acctbal > 0",
    "newer_events": "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00'",
    "union_all": """
        SELECT c_name AS name, c_acctbal AS balance FROM customer
        UNION ALL SELECT s_name, s_acctbal FROM supplier""",
    "schema_merge": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
               CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_orderpriority END AS o_orderpriority
        FROM orders""",
    "param_query": "SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_totalprice > 250000 GROUP BY 1",
    "sql_script": """
        WITH spend AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend
                       FROM orders GROUP BY 1)
        SELECT c_mktsegment AS segment, count(*) AS customers, 'a;b' AS mark
        FROM spend JOIN customer ON o_custkey = c_custkey WHERE spend > 2000000 GROUP BY 1""",
    "named_scan": "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
}
