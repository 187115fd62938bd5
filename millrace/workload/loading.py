"""Configuration documents made from the documents table, one JSON document per row.

The language decides what is wrong with a document: `de` lacks a task type, `fr`
depends on a task it does not have, `es` has a cycle; `en` is sound.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.temporal import at as moment
from millrace.plans import config_load, job_plan as plan
from millrace.plans.tasks import ingest_rows
from millrace.operators.validate import load_status, load_summary
from millrace.sinks.tables import write_verified
from millrace.sources.documents import json_jobs, yaml, yaml_jobs
from millrace.sources.staging import scratch_path
from millrace.workload import at, table

AS_OF, BEFORE = "2024-06-01 00:00:00", "2024-01-01 00:00:00"
VARIABLES = {"root": "/jobs", "prefix": "doc"}


def _documents(spark, d):
    lang = F.col("lang")
    tasks = F.array(
        F.struct(
            F.lit("extract").alias("task_key"), F.lit("notebook").alias("task_type"),
            F.when(lang == "es", F.array(F.lit("load"))).alias("depends_on"),
            F.concat(F.lit("${var.root}/"), F.col("source")).alias("file_path"),
        ),
        F.struct(
            F.lit("load").alias("task_key"), F.when(lang != "de", F.lit("sql_file")).alias("task_type"),
            F.array(F.when(lang == "fr", F.lit("transform")).otherwise(F.lit("extract"))).alias("depends_on"),
            F.lit("load.sql").alias("file_path"),
        ),
    )
    job = F.struct(F.col("source").alias("name"), F.col("n_chars").alias("timeout_seconds"), tasks.alias("tasks"))
    key = F.concat(F.lit("${var.prefix}_"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("path"),
        F.to_json(F.struct(F.create_map(key, job).alias("jobs"))).alias("content"),
    )


def _control(spark, d):
    """Labelled documents are in the control table already, with a task that is gone since."""
    keys = F.explode(F.array(F.lit("extract"), F.lit("old"))).alias("task_key")
    return table(spark, d, "labels").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("resource_id"), keys, "quality", "toxic"
    ).select(
        "resource_id", F.lit("before").alias("job_name"), "task_key", F.lit("[]").alias("depends_on"),
        F.lit("notebook").alias("task_type"), F.lit("{}").alias("job_config"), F.lit("{}").alias("task_config"),
        F.lit(False).alias("disabled"), F.lit("first").alias("created_by"), at(BEFORE).alias("created_timestamp"),
        F.lit("first").alias("updated_by"), at(BEFORE).alias("updated_timestamp"),
    )


def _load(spark, d, how=config_load.load_isolated, documents=None, **options):
    jobs = json_jobs(documents if documents is not None else _documents(spark, d))
    return how(_control(spark, d), jobs, at(AS_OF), F.lit("second"), VARIABLES, **options)


def config_isolated(spark, d):
    return _load(spark, d).table


def config_actions(spark, d):
    return _load(spark, d).counts


def config_problems(spark, d):
    return _load(spark, d).problems.select("resource_id", "task_key", "reason")


def config_repeated_ids(spark, d):
    """Documents that name their job twice, as some of `en` do here, are told apart from sound ones."""
    twice = F.regexp_replace("content", r'^\{"jobs":\{("[^"]+":)(.*)\}\}$', r'{"jobs":{$1$2,$1$2}}')
    content = F.when(F.col("path").cast("bigint") % 3 == 0, twice).otherwise(F.col("content"))
    documents = _documents(spark, d).withColumn("content", content)
    jobs = json_jobs(documents).select("path", "resource_id", "reason")
    return jobs.groupBy("path", "resource_id", "reason").agg(F.count(F.lit(1)).alias("entries"))


def config_summary(spark, d):
    """Tasks and jobs loaded, jobs that failed, tasks deleted."""
    load = _load(spark, d)
    failed = load.problems.filter("resource_id IS NOT NULL")
    return load_summary(load.accepted, failed, "resource_id", load.merged)


def config_bad_values(spark, d):
    """Timeouts that are no numbers, and keys that mean one task once they are cleaned, are problems."""
    lang = F.col("lang")
    tasks = F.array(*(
        F.struct(key.alias("task_key"), F.lit("notebook").alias("task_type"), F.lit("p").alias("file_path"))
        for key in (F.lit("load-all"), F.when(lang == "de", "load.all").otherwise("other"))
    ))
    job = F.struct(F.when(lang == "fr", "soon").otherwise(F.col("n_chars").cast("string")).alias("timeout_seconds"), tasks.alias("tasks"))
    documents = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("path"),
        F.to_json(F.struct(F.create_map(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), job).alias("jobs"))).alias("content"),
    )
    return _load(spark, d, documents=documents).problems.select("resource_id", "task_key", "reason")


def config_atomic_fail(spark, d):
    return _load(spark, d, config_load.load_atomic, scope="all").table


def config_atomic_pass(spark, d):
    """The same documents with their tasks put right."""
    content = F.regexp_replace("content", '"depends_on":\\["(transform|load)"\\]', '"depends_on":[]')
    content = F.regexp_replace(content, '"task_key":"load","depends_on"', '"task_key":"load","task_type":"sql_file","depends_on"')
    return _load(spark, d, config_load.load_atomic, _documents(spark, d).withColumn("content", content)).table


def task_rows(spark, d):
    rows = config_load.task_rows(config_load.job_rows(json_jobs(_documents(spark, d)), VARIABLES))
    return rows.select("resource_id", "job_name", "task_key", "depends_on", "task_type", "job_config", "task_config", "disabled")


def _planned_control(spark, d):
    """Documents as single-task jobs with a schedule, a trigger or nothing."""
    config = (
        F.when(F.col("lang") == "de", F.lit('{"schedule":{"pause_status":"UNPAUSED"},"timeout_seconds":60}'))
        .when(F.col("lang") == "fr", F.lit('{"trigger":{"file_arrival":{}},"edit_mode":"EDITABLE"}'))
        .otherwise("{}")
    )
    keys = F.explode(F.array(F.lit("b-load"), F.lit("a extract"))).alias("task_key")
    return table(spark, d, "documents").select("*", keys).select(
        F.col("doc_id").alias("resource_id"), F.col("source").alias("job_name"), "task_key",
        F.when(F.col("task_key") == "b-load", '["a extract"]').otherwise("[]").alias("depends_on"),
        F.lit("sql_file").alias("task_type"), config.alias("job_config"),
        F.to_json(F.struct(
            F.concat(F.col("lang"), F.lit(".sql")).alias("file_path"),
            F.when(F.col("lang") != "es", F.col("source")).otherwise("your-warehouse-id").alias("warehouse_id"),
            F.struct("n_chars").alias("parameters"),
        )).alias("task_config"),
        F.lit(False).alias("disabled"),
    )


def job_plan(spark, d):
    ids = table(spark, d, "labels").select(
        F.col("doc_id").alias("resource_id"), (F.col("doc_id") * 10).alias("job_id"), "toxic"
    )
    planned = plan.job_plan(_planned_control(spark, d), ids, ids.filter("toxic = 0"), paused=True, prefix="[jobs] ")
    return planned.select(
        "resource_id", "display_name", "action", "job_id", "timeout_seconds", "max_concurrent_runs", "edit_mode",
        "pause_status", "run_now", "schedule", "trigger",
    )


def task_plan(spark, d):
    planned = plan.task_plan(_planned_control(spark, d))
    return planned.select(
        "resource_id", "task_key", "cleaned_key", "level", "run_if", "task_timeout_seconds", "warehouse_id", "file_source",
        "parameters", F.array_join("cleaned_depends_on", ",").alias("needs"), F.array_join("reasons", ",").alias("reasons"),
    )


def write_counts(spark, d):
    """Ingest customers into a fresh folder; the counts are observed on the write."""
    path = scratch_path(spark, "customers")
    counts = write_verified(
        table(spark, d, "customer"),
        lambda df: ingest_rows(df, "customer_ingestion", moment(AS_OF), ("c_mktsegment", "BUILDING"), ("c_name", "c_mktsegment")),
        lambda df: df.write.parquet(path),
        lambda: spark.read.parquet(path).count(),
    )
    frame = spark.createDataFrame([counts], "rows_read bigint, rows_kept bigint, rows_in_target bigint")
    return load_status(frame)


def yaml_task_rows(spark, d):
    """The same documents read by the YAML parser, of which JSON is a part."""
    jobs = yaml_jobs(_documents(spark, d))
    rows = config_load.task_rows(config_load.job_rows(jobs, VARIABLES))
    return rows.select("resource_id", "job_name", "task_key", "depends_on", "task_type", "job_config", "task_config", "disabled")


QUERIES = {
    "task_rows": task_rows,
    "config_isolated": config_isolated,
    "config_actions": config_actions,
    "config_problems": config_problems,
    "config_repeated_ids": config_repeated_ids,
    "config_summary": config_summary,
    "config_bad_values": config_bad_values,
    "config_atomic_fail": config_atomic_fail,
    "config_atomic_pass": config_atomic_pass,
    "job_plan": job_plan,
    "task_plan": task_plan,
    "write_counts": write_counts,
}

_ROWS = """
WITH doc AS (SELECT 'doc_' || doc_id AS resource_id, source AS job_name, lang, n_chars FROM documents),
     task AS (SELECT resource_id, job_name, lang, 'extract' AS task_key,
                     CASE WHEN lang = 'es' THEN '["load"]' ELSE '[]' END AS depends_on, 'notebook' AS task_type,
                     '{"timeout_seconds":' || n_chars || '}' AS job_config,
                     '{"file_path":"/jobs/' || job_name || '"}' AS task_config FROM doc
              UNION ALL
              SELECT resource_id, job_name, lang, 'load', CASE WHEN lang = 'fr' THEN '["transform"]' ELSE '["extract"]' END,
                     CASE WHEN lang <> 'de' THEN 'sql_file' END, '{"timeout_seconds":' || n_chars || '}',
                     '{"file_path":"load.sql"}' FROM doc),
     control AS (SELECT 'doc_' || doc_id AS resource_id, k AS task_key FROM labels, (VALUES ('extract'), ('old')) v(k))
"""
_BEFORE = """
SELECT c.resource_id, 'before' AS job_name, c.task_key, '[]' AS depends_on, 'notebook' AS task_type, '{}' AS job_config,
       '{}' AS task_config, false AS disabled, 'first' AS created_by, TIMESTAMP '2024-01-01' AS created_timestamp,
       'first' AS updated_by, TIMESTAMP '2024-01-01' AS updated_timestamp
FROM control c
"""
_LOADED = """
SELECT t.resource_id, t.job_name, t.task_key, {depends_on}, {task_type}, t.job_config, t.task_config, false,
       CASE WHEN c.task_key IS NULL THEN 'second' ELSE 'first' END,
       CASE WHEN c.task_key IS NULL THEN TIMESTAMP '2024-06-01' ELSE TIMESTAMP '2024-01-01' END,
       'second', TIMESTAMP '2024-06-01'
FROM task t LEFT JOIN control c ON c.resource_id = t.resource_id AND c.task_key = t.task_key
"""

SQL = {
    "task_rows": _ROWS + """
        SELECT resource_id, job_name, task_key, depends_on, task_type, job_config, task_config, false AS disabled FROM task""",
    "config_isolated": _ROWS + _BEFORE + """
        WHERE c.resource_id NOT IN (SELECT resource_id FROM doc WHERE lang = 'en')
        UNION ALL""" + _LOADED.format(depends_on="t.depends_on", task_type="t.task_type") + "WHERE lang = 'en'",
    "config_actions": _ROWS + """
        SELECT action, count(*) AS rows FROM (
            SELECT CASE WHEN c.task_key IS NULL THEN 'insert' WHEN t.task_key IS NOT NULL THEN 'update'
                        WHEN c.resource_id IN (SELECT resource_id FROM doc WHERE lang = 'en') THEN 'delete'
                        ELSE 'keep' END AS action
            FROM (SELECT * FROM task WHERE lang = 'en') t
            FULL JOIN control c ON c.resource_id = t.resource_id AND c.task_key = t.task_key)
        GROUP BY action""",
    "config_problems": _ROWS + """
        SELECT resource_id, 'load' AS task_key, 'missing:task_type' AS reason FROM doc WHERE lang = 'de'
        UNION ALL SELECT resource_id, 'load', 'missing_dependency' FROM doc WHERE lang = 'fr'
        UNION ALL SELECT resource_id, NULL, 'cycle' FROM doc WHERE lang = 'es'""",
    "config_repeated_ids": """
        SELECT CAST(doc_id AS VARCHAR) AS path, '${var.prefix}_' || doc_id AS resource_id,
               CASE WHEN doc_id % 3 = 0 THEN 'repeated_resource_id' END AS reason,
               CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS entries FROM documents""",
    "config_summary": _ROWS + """
        SELECT (SELECT count(*) FROM task WHERE lang = 'en') AS tasks_loaded,
               (SELECT count(*) FROM doc WHERE lang = 'en') AS jobs_loaded,
               (SELECT count(*) FROM doc WHERE lang <> 'en') AS jobs_failed,
               (SELECT count(*) FROM control WHERE task_key = 'old'
                AND resource_id IN (SELECT resource_id FROM doc WHERE lang = 'en')) AS tasks_deleted""",
    "config_bad_values": """
        SELECT 'doc_' || doc_id AS resource_id, k AS task_key, 'cleaned_key_collision' AS reason
        FROM documents, (VALUES ('load-all'), ('load.all')) v(k) WHERE lang = 'de'
        UNION ALL
        SELECT 'doc_' || doc_id, k, 'bad_value:timeout_seconds'
        FROM documents, (VALUES ('load-all'), ('other')) v(k) WHERE lang = 'fr'""",
    "config_atomic_fail": _ROWS + _BEFORE,
    "config_atomic_pass": _ROWS + _BEFORE + "WHERE c.resource_id NOT IN (SELECT resource_id FROM doc) UNION ALL"
    + _LOADED.format(
        depends_on="CASE WHEN lang = 'es' AND t.task_key = 'extract' OR lang = 'fr' THEN '[]' ELSE t.depends_on END",
        task_type="coalesce(t.task_type, 'sql_file')",
    ),
    "job_plan": """
        SELECT d.doc_id AS resource_id, '[jobs] ' || source AS display_name,
               CASE WHEN l.doc_id IS NULL THEN 'CREATE' WHEN toxic = 0 THEN 'UPDATE' ELSE 'RECREATE' END AS action,
               CASE WHEN toxic = 0 THEN d.doc_id * 10 END AS job_id,
               CASE WHEN lang = 'de' THEN 60 ELSE 7200 END AS timeout_seconds, 1 AS max_concurrent_runs,
               CASE WHEN lang = 'fr' THEN 'EDITABLE' ELSE 'UI_LOCKED' END AS edit_mode,
               CASE WHEN lang = 'de' THEN 'UNPAUSED' WHEN lang = 'fr' AND coalesce(toxic, 1) = 1 THEN 'PAUSED' END
                   AS pause_status,
               false AS run_now, CASE WHEN lang = 'de' THEN '{"pause_status":"UNPAUSED"}' END AS schedule,
               CASE WHEN lang = 'fr' THEN '{"file_arrival":{}}' END AS trigger
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "task_plan": """
        SELECT doc_id AS resource_id, k AS task_key, replace(replace(k, '-', '_'), ' ', '_') AS cleaned_key,
               CASE WHEN k = 'b-load' THEN 1 ELSE 0 END AS level, CAST(NULL AS VARCHAR) AS run_if,
               3600 AS task_timeout_seconds, CASE WHEN lang <> 'es' THEN source END AS warehouse_id,
               CASE WHEN k = 'b-load' THEN 'a_extract' ELSE '' END AS needs, 'WORKSPACE' AS file_source, '{"n_chars":"' || n_chars || '"}' AS parameters,
               CASE WHEN lang = 'es' THEN 'missing:warehouse_id' ELSE '' END AS reasons
        FROM documents, (VALUES ('b-load'), ('a extract')) v(k)""",
    "write_counts": """
        SELECT 'data_validation' AS validation_type, 'SUCCESS' AS status, count(*) AS rows_read,
               count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS rows_kept,
               count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS rows_in_target FROM customer""",
}

if yaml is not None:
    QUERIES["yaml_task_rows"] = yaml_task_rows
    SQL["yaml_task_rows"] = SQL["task_rows"]
