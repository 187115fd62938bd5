"""Validation, quarantine and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import validate as v
from millrace.workload import table
from millrace.workload.changes import create_or_update


def repeated_keys(spark, d):
    return v.repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def repeated_texts(spark, d):
    """Whole texts, shuffled as digests."""
    digests = table(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), "source")
    return v.repeated_keys(digests, ["digest"], where="source")


def _codes(checked, *columns):
    return checked.select(*columns, F.array_join("reasons", ",").alias("reasons"))


def required_fields(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "lang", "source")
    labelled = documents.join(table(spark, d, "labels"), "doc_id", "left")
    checked = v.with_reasons(labelled, v.missing_required(["lang", "quality", "toxic"]))
    return _codes(checked, "doc_id")


def _numbered(spark, d):
    """Events with the number k of their props, parsed once."""
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _tasks(spark, d):
    """Events as tasks: the event type picks a task type, the props become settings."""
    k = F.col("k")
    kind = (
        F.when(F.col("event_type") == "click", "notebook")
        .when(F.col("event_type") == "view", "sql_query")
        .when(F.col("event_type") == "purchase", "python_wheel")
        .when(F.col("event_type") == "signup", "dbt")
        .otherwise("shell")
    )
    text = k.cast("string")
    config = F.to_json(
        F.struct(
            F.when(k < 50, F.concat(F.lit("/jobs/"), text)).alias("file_path"),
            F.when(k > 20, F.lit("SELECT 1")).alias("sql_query"),
            F.when(k > 40, F.lit("Your-Warehouse-Id")).otherwise(F.when(k > 10, text)).alias("warehouse_id"),
            F.when(k != 7, F.lit("pkg")).alias("package_name"),
            F.when(k > 30, F.lit("main")).alias("entry_point"),
            F.when(k > 60, F.array(F.lit(" dbt run"), F.lit("edr report")))
            .when(k > 30, F.array(F.lit("dbt run"), F.lit("rm x")))
            .alias("commands"),
        )
    )
    return _numbered(spark, d).select("event_id", kind.alias("task_type"), config.alias("task_config"))


def fields_by_type(spark, d):
    return _codes(v.with_type_reasons(_tasks(spark, d)), "event_id")


def known_types(spark, d):
    return _tasks(spark, d).groupBy(v.known_type(F.col("task_type")).alias("known")).agg(F.count(F.lit(1)).alias("tasks"))


def dependency_lists(spark, d):
    k = F.col("k")
    depends_on = (
        F.when(k < 20, F.lit("[]")).when(k < 40, F.lit('["a", "b"]')).when(k < 60, F.lit('{"a": 1}'))
        .when(k < 70, F.lit("[1]")).when(k < 80, F.lit("[oops"))
    )
    events = _numbered(spark, d).select("event_id", depends_on.alias("depends_on"))
    return _codes(v.with_dependency_reasons(events), "event_id")


def _turns(spark, d, shortest):
    turns = table(spark, d, "conversations")
    rules = {"short_text": F.length("text") < shortest, "unknown_role": ~F.col("role").isin("user", "assistant", "system")}
    return v.with_reasons(turns, rules)


def quarantine_valid(spark, d):
    return v.quarantine(_turns(spark, d, 60), ["conv_id"])[0]


def quarantine_rejected(spark, d):
    return _codes(v.quarantine(_turns(spark, d, 60), ["conv_id"])[1], "conv_id", "turn", "role", "text")


def rejected_groups(spark, d):
    return v.rejected_groups(_turns(spark, d, 60), ["conv_id"])


def all_or_nothing_pass(spark, d):
    return v.all_or_nothing(_turns(spark, d, 1))


def all_or_nothing_fail(spark, d):
    return v.all_or_nothing(_turns(spark, d, 60))


def load_summary(spark, d):
    accepted, rejected = v.quarantine(_turns(spark, d, 60), ["conv_id"])
    return v.load_summary(accepted, rejected, "conv_id")


def run_summary(spark, d):
    planned = create_or_update(spark, d)
    error = F.when(F.col("action") == "RECREATE", F.concat(F.lit("no longer live: "), F.col("job_id").cast("string")))
    return v.run_summary(planned.withColumn("error", error))


def run_outcomes(spark, d):
    """Every planned document with its status and error."""
    planned = create_or_update(spark, d)
    error = F.when(F.col("action") == "RECREATE", F.concat(F.lit("no longer live: "), F.col("job_id").cast("string")))
    return v.run_outcomes(planned.withColumn("error", error), "resource_id")


def key_collisions(spark, d):
    mark = F.when(F.col("p_size") > 25, "-").when(F.col("p_size") > 10, ".").otherwise("_")
    parts = table(spark, d, "part").select("p_type", F.concat("p_name", mark, "p_brand").alias("task_key"))
    return v.key_collisions(parts, ["p_type"], "task_key")


QUERIES = {
    "repeated_keys": repeated_keys,
    "repeated_texts": repeated_texts,
    "required_fields": required_fields,
    "fields_by_type": fields_by_type,
    "known_types": known_types,
    "dependency_lists": dependency_lists,
    "quarantine_valid": quarantine_valid,
    "quarantine_rejected": quarantine_rejected,
    "rejected_groups": rejected_groups,
    "all_or_nothing_pass": all_or_nothing_pass,
    "all_or_nothing_fail": all_or_nothing_fail,
    "load_summary": load_summary,
    "run_summary": run_summary,
    "run_outcomes": run_outcomes,
    "key_collisions": key_collisions,
}

_K = "WITH e AS (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)"
_BAD = "WITH bad AS (SELECT DISTINCT conv_id FROM conversations WHERE length(text) < 60)"

SQL = {
    "repeated_keys": """
        SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
    "repeated_texts": """
        SELECT sha256(text) AS digest, count(*) AS copies, count(DISTINCT source) AS places
        FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "required_fields": """
        SELECT d.doc_id, concat_ws(',', CASE WHEN coalesce(lang, '') = '' THEN 'missing:lang' END,
                                   CASE WHEN quality IS NULL THEN 'missing:quality' END,
                                   CASE WHEN toxic IS NULL THEN 'missing:toxic' END) AS reasons
        FROM documents d LEFT JOIN labels USING (doc_id)""",
    "fields_by_type": _K + """
        SELECT event_id, CASE event_type
            WHEN 'click' THEN CASE WHEN k >= 50 THEN 'notebook:missing:file_path' ELSE '' END
            WHEN 'view' THEN concat_ws(',', CASE WHEN k <= 20 THEN 'sql_query:missing:sql_query|query_id' END,
                                       CASE WHEN k > 40 OR k <= 10 THEN 'missing:warehouse_id' END)
            WHEN 'purchase' THEN concat_ws(',', CASE WHEN k = 7 THEN 'python_wheel:missing:package_name' END,
                                           CASE WHEN k <= 30 THEN 'python_wheel:missing:entry_point' END)
            WHEN 'signup' THEN concat_ws(',', CASE WHEN k <= 30 THEN 'dbt:missing:commands' END,
                                         CASE WHEN k > 30 AND k <= 60 THEN 'bad_command' END)
            ELSE 'unknown_type' END AS reasons
        FROM e""",
    "known_types": "SELECT event_type <> 'error' AS known, count(*) AS tasks FROM events GROUP BY 1",
    "dependency_lists": _K + """
        SELECT event_id, CASE WHEN k >= 40 AND k < 70 THEN 'depends_on_not_a_list_of_keys'
                              WHEN k >= 70 AND k < 80 THEN 'broken_depends_on' ELSE '' END AS reasons FROM e""",
    "quarantine_valid": _BAD + "SELECT * FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM bad)",
    "quarantine_rejected": _BAD + """
        SELECT *, CASE WHEN length(text) < 60 THEN 'short_text' ELSE '' END AS reasons
        FROM conversations WHERE conv_id IN (SELECT conv_id FROM bad)""",
    "rejected_groups": """
        SELECT conv_id, count(*) AS bad_rows, 'short_text' AS reasons FROM conversations WHERE length(text) < 60 GROUP BY 1""",
    "all_or_nothing_pass": """
        SELECT * FROM conversations WHERE NOT EXISTS (SELECT 1 FROM conversations WHERE length(text) < 1)""",
    "all_or_nothing_fail": """
        SELECT * FROM conversations WHERE NOT EXISTS (SELECT 1 FROM conversations WHERE length(text) < 60)""",
    "load_summary": _BAD + """
        SELECT count(*) FILTER (WHERE ok) AS tasks_loaded, count(DISTINCT conv_id) FILTER (WHERE ok) AS jobs_loaded,
               count(DISTINCT conv_id) FILTER (WHERE NOT ok) AS jobs_failed
        FROM (SELECT conv_id, conv_id NOT IN (SELECT conv_id FROM bad) AS ok FROM conversations)""",
    "run_summary": """
        SELECT CASE WHEN toxic = 1 THEN 'failed' ELSE 'succeeded' END AS status, count(*) AS jobs
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "run_outcomes": """
        SELECT doc_id AS resource_id, CASE WHEN toxic = 1 THEN 'failed' ELSE 'succeeded' END AS status,
               CASE WHEN toxic = 1 THEN 'no longer live: ' || (doc_id * 10 + quality) END AS error
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "key_collisions": """
        WITH keys AS (SELECT DISTINCT p_type, p_name || CASE WHEN p_size > 25 THEN '-' WHEN p_size > 10 THEN '.' ELSE '_' END
                             || p_brand AS task_key FROM part)
        SELECT p_type, trim(regexp_replace(task_key, '[^a-zA-Z0-9]+', '_', 'g'), '_') AS cleaned_key, count(*) AS keys
        FROM keys GROUP BY 1, 2 HAVING count(*) > 1""",
}
