"""Streams over the test tables: everything available, then the result is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import validate as v
from millrace.operators.ranking import newest_per_key
from millrace.operators.transform import present_and_positive
from millrace.plans import config_load
from millrace.sources.documents import json_jobs
from millrace.sources.staging import scratch_path
from millrace.plans.sales import to_silver
from millrace.streaming import counted, daily, flows, ledger, quarantine, sync
from millrace.workload import at, loading, plain, table
from millrace.workload.relational import _DAILY_SQL, AS_OF, order_lines


BATCHES = 4
ROWS = 1_000_000  # of a file


def _arrivals(spark, d, name, df):
    """The table as a stream of BATCHES batches, dealt round, so that every group of rows is spread over them; a batch is as many files as it has ROWS."""
    files = max(1, -(-df.count() // (BATCHES * ROWS)))
    path = scratch_path(spark, name)
    df.repartition(BATCHES * files).write.parquet(path)
    return flows.file_arrivals(spark, path, df.schema, files_per_batch=files)


def stream_silver(spark, d):
    events = table(spark, d, "events")
    target, checkpoint = scratch_path(spark, "silver"), scratch_path(spark, "silver-checkpoint")
    arrivals = _arrivals(spark, d, "arrivals", events)

    def clean(df):
        kept = present_and_positive(df, ["event_id", "user_id"], ["value"])
        return kept.select("event_id", "ts", "user_id", F.upper("event_type").alias("event_type"), "value")

    flows.append_flow(arrivals, clean, target, checkpoint).awaitTermination()
    return spark.read.parquet(target)


def stream_merge(spark, d):
    """The newest event of every user, merged batch by batch into snapshots."""
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    root, checkpoint = scratch_path(spark, "users"), scratch_path(spark, "users-checkpoint")
    sync.seed(spark.createDataFrame([], events.schema), root)
    arrivals = _arrivals(spark, d, "arrivals", events)
    sync.merge_flow(
        arrivals, root, events.schema, ["user_id"], checkpoint,
        prepare=lambda batch: newest_per_key(batch, ["user_id"], "ts", [F.col("event_id").desc()]),
        when=lambda t, s: (t("ts") < s("ts")) | ((t("ts") == s("ts")) & (t("event_id") < s("event_id"))),
    ).awaitTermination()
    return sync.snapshot(spark, root, events.schema)


def _quarantined(spark, d):
    """Turns arrive in batches that each hold some turns of a conversation; one short turn rejects all of them."""
    turns = table(spark, d, "conversations")
    root, checkpoint = scratch_path(spark, "quarantine"), scratch_path(spark, "turns-checkpoint")
    quarantine.quarantine_flow(
        _arrivals(spark, d, "turns", turns),
        lambda batch: v.with_reasons(batch, {"short_text": F.length("text") < 60}), ["conv_id"], root, checkpoint,
    ).awaitTermination()
    return quarantine.quarantined(spark, root, turns.schema, ["conv_id"])


def stream_accepted(spark, d):
    return _quarantined(spark, d)[0]


def stream_rejected(spark, d):
    rejected = _quarantined(spark, d)[1]
    return rejected.withColumn("reasons", F.array_join("reasons", ","))


def stream_config(spark, d):
    """Documents arrive as a stream and are loaded into control-table snapshots."""
    documents = loading._documents(spark, d)
    control = loading._control(spark, d)
    root, rejects, checkpoint = (scratch_path(spark, x) for x in ("control", "problems", "control-checkpoint"))
    sync.seed(control, root)
    arrivals = _arrivals(spark, d, "documents", documents)
    sync.control_flow(
        arrivals, json_jobs,
        lambda table, jobs, as_of: config_load.load_isolated(table, jobs, as_of, F.lit("second"), loading.VARIABLES),
        root, rejects, control.schema, checkpoint, lambda batch_id: at(loading.AS_OF),
    ).awaitTermination()
    return sync.snapshot(spark, root, control.schema)


def stream_partitions(spark, d):
    """Orders arrive again with new prices and are merged into a table partitioned by year."""
    orders = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    old = orders.filter(F.col("o_orderdate") < at("2000-01-01"))
    new = orders.filter(F.col("o_orderdate") >= at("1999-01-01")).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    path, checkpoint = scratch_path(spark, "orders"), scratch_path(spark, "orders-checkpoint")
    old.write.partitionBy("year").parquet(path)
    arrivals = _arrivals(spark, d, "arrivals", new)
    sync.partition_merge_flow(
        arrivals, path, orders.schema, ["year", "o_orderkey"], ["year"], checkpoint
    ).awaitTermination()
    return spark.read.schema(orders.schema).parquet(path)


def _sound_events(df):
    kept = present_and_positive(df, ["event_id", "user_id"], ["value"])
    return kept.select("event_id", "user_id", F.upper("event_type").alias("event_type"), "value")


def _event_files(spark, d, root):
    """A folder that gets the events of one remainder of their id at a time: (schema, arrive(number))."""
    events = table(spark, d, "events")

    def arrive(number):
        part = events.filter(F.pmod("event_id", F.lit(BATCHES)) == number).coalesce(1)
        part.write.mode("append").parquet(root)

    return events.schema, arrive


def _counted(spark, d, stops=()):
    """Events that arrive file by file; the load is stopped after the batches in stops, and started again."""
    source, root, checkpoint = (scratch_path(spark, x) for x in ("arrivals", "counted", "counted-checkpoint"))
    schema, arrive = _event_files(spark, d, source)
    arrive(0)

    def start():
        arrivals = flows.file_arrivals(spark, source, schema, files_per_batch=1)
        return counted.counted_flow(arrivals, _sound_events, root, checkpoint, "10 milliseconds")

    query = start()
    for number in range(BATCHES):
        if number:
            arrive(number)
        query.processAllAvailable()
        if number in stops:
            query.stop()
            query = start()
    query.stop()
    return root


def stream_write_counts(spark, d):
    """Rows read, kept and written of every batch."""
    return ledger.finished(spark, _counted(spark, d))


def stream_restart(spark, d):
    """What a load wrote that was stopped and started again after its first and third batch."""
    root = _counted(spark, d, stops=(0, 2))
    schema = _sound_events(table(spark, d, "events").limit(0)).schema
    return ledger.batches(spark, root, schema)


def stream_daily(spark, d):
    """The daily summary, kept up to date while order lines arrive."""
    lines = order_lines(spark, d)
    root, checkpoint = scratch_path(spark, "daily"), scratch_path(spark, "daily-checkpoint")
    silver = lambda batch: to_silver(batch, at(AS_OF))
    schema = silver(lines).schema
    daily.daily_flow(_arrivals(spark, d, "lines", lines), silver, schema, root, checkpoint, done="F").awaitTermination()
    return plain(daily.daily_so_far(spark, schema, root, at(AS_OF)))


QUERIES = {
    "stream_write_counts": stream_write_counts,
    "stream_restart": stream_restart,
    "stream_daily": stream_daily,
    "stream_partitions": stream_partitions,
    "stream_silver": stream_silver,
    "stream_merge": stream_merge,
    "stream_accepted": stream_accepted,
    "stream_rejected": stream_rejected,
    "stream_config": stream_config,
}

_BAD = "WITH bad AS (SELECT DISTINCT conv_id FROM conversations WHERE length(text) < 60)"

SQL = {
    "stream_write_counts": f"""
        SELECT event_id % {BATCHES} AS batch_id, count(*) AS rows_read,
               count(*) FILTER (WHERE user_id IS NOT NULL AND value > 0) AS rows_kept,
               count(*) FILTER (WHERE user_id IS NOT NULL AND value > 0) AS rows_written
        FROM events GROUP BY 1""",
    "stream_restart": f"""
        SELECT event_id, user_id, upper(event_type) AS event_type, value, event_id % {BATCHES} AS batch_id
        FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND value > 0""",
    "stream_daily": _DAILY_SQL.format(where=""),
    "stream_partitions": """
        SELECT * REPLACE (CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN o_totalprice + 1 ELSE o_totalprice END
                          AS o_totalprice), CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""",
    "stream_silver": """
        SELECT event_id, ts, user_id, upper(event_type) AS event_type, value FROM events
        WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND value > 0""",
    "stream_merge": """
        SELECT user_id, ts, event_id, event_type, value FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
        WHERE rn = 1""",
    "stream_accepted": _BAD + "SELECT * FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM bad)",
    "stream_rejected": _BAD + """
        SELECT *, CASE WHEN length(text) < 60 THEN 'short_text' ELSE '' END AS reasons
        FROM conversations WHERE conv_id IN (SELECT conv_id FROM bad)""",
    "stream_config": loading.SQL["config_isolated"],
}
