"""Settings, templates, keys and names, row by row over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import json as j
from millrace.functions import text as x
from millrace.operators import settings as s
from millrace.sources.documents import file_name, has_document_name
from millrace.workload import table


def _k():
    return F.col("k")


def _numbered(spark, d):
    """Events with the number k of their props, parsed once."""
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _configs(spark, d):
    """Events with a job settings text made from their props."""
    config = F.to_json(
        F.struct(
            _k().alias("timeout_seconds"),
            F.array("event_type").alias("environments"),
            F.struct(F.col("user_id").alias("owner")).alias("tags"),
            F.when(_k() > 50, F.lit(True)).alias("scratch"),
            F.when(_k() > 70, F.struct((_k() > 85).alias("enabled"))).alias("queue"),
        )
    )
    return _numbered(spark, d).select("event_id", config.alias("config"))


def settings_keep(spark, d):
    return _configs(spark, d).select("event_id", s.job_settings(j.parse_object("config")).alias("job_config"))


def settings_drop(spark, d):
    kept = j.drop_keys(j.parse_object("config"), ["tags", "environments"])
    return _configs(spark, d).select("event_id", F.to_json(kept).alias("config"))


def settings_default(spark, d):
    text = F.when(_k() > 30, F.col("props"))
    renamed = F.regexp_replace(text, '"k"', '"timeout_seconds"')
    events = _numbered(spark, d).select("event_id", renamed.alias("job_config"))
    return s.with_job_settings(events).select("event_id", "timeout_seconds", "max_concurrent_runs", "queue")


def json_states(spark, d):
    text = (
        F.when(_k() < 20, F.col("props")).when(_k() < 40, F.lit("[1, 2]")).when(_k() < 60, F.lit("{broken"))
        .when(_k() < 70, F.lit("12")).when(_k() < 80, F.lit("null"))
    )
    return _numbered(spark, d).select("event_id", j.json_state(text).alias("state"))


def pause_default(spark, d):
    is_new = F.col("event_type") != "view"
    has_trigger = F.col("event_type").isin("view", "click", "purchase")
    explicit = F.when(_k() > 80, "PAUSED").when(_k() > 60, "UNPAUSED")
    return _numbered(spark, d).select(
        "event_id",
        s.pause_status(is_new, has_trigger, explicit, F.col("value") > 50).alias("pause_status"),
        s.starts_at_once(is_new, has_trigger, F.col("value") > 50).alias("run_now"),
    )


def placeholder_default(spark, d):
    value = (
        F.when(F.col("c_mktsegment") == "BUILDING", "your-warehouse-id")
        .when(F.col("c_mktsegment") == "MACHINERY", "YOUR_WAREHOUSE_ID")
        .when(F.col("c_mktsegment") == "FURNITURE", "")
        .otherwise(F.col("c_name"))
    )
    return table(spark, d, "customer").select(
        "c_custkey", s.without_placeholder(value, F.lit("shared")).alias("warehouse_id")
    )


def domain_fallback(spark, d):
    wish = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "ALL_DONE")
        .when(F.col("o_orderpriority") == "2-HIGH", "NONE_FAILED")
        .when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority"))
    )
    source = F.when(F.col("o_orderstatus") == "F", "GIT").otherwise(F.col("o_orderstatus"))
    mode = F.when(F.col("o_orderstatus") == "F", "UI_LOCKED").when(F.col("o_orderstatus") == "O", "EDITABLE")
    return table(spark, d, "orders").select(
        "o_orderkey",
        s.run_condition(wish).alias("run_if"),
        s.outside_domain(wish, s.RUN_CONDITIONS).alias("warning"),
        s.file_source(source).alias("file_source"),
        s.edit_mode(mode).alias("edit_mode"),
    )


def parameters(spark, d):
    kind = F.when(F.col("event_type") == "click", "python_wheel").otherwise("notebook")
    text = (
        F.when(_k() < 30, F.to_json(F.struct("user_id", (F.col("value") > 50).alias("big"))))
        .when(_k() < 60, F.to_json(F.array(F.col("event_type"), F.lit("x"))))
    )
    return _numbered(spark, d).select("event_id", s.normalised_parameters(kind, text).alias("parameters"))


def clean_keys(spark, d):
    pages = table(spark, d, "pages").select(F.col("url").alias("raw_key"))
    paths = pages.select(F.regexp_replace("raw_key", "^https?:", "").alias("raw_key"))
    parts = table(spark, d, "part").select(F.concat("p_brand", F.lit("__"), "p_name", F.lit("_")).alias("raw_key"))
    keys = pages.unionByName(paths).unionByName(parts)
    return keys.select("raw_key", x.clean_key(F.col("raw_key")).alias("cleaned_key"))


def _templates(spark, d):
    text = F.when(
        F.col("c_mktsegment") == "FURNITURE", F.lit("${var.name} owes ${var.amount}; ${var.amount}, ${var.date}")
    ).otherwise(F.concat(F.lit("${var.name}/${env}/${var.nation}${var.name}-"), F.col("c_mktsegment")))
    values = F.create_map(
        F.lit("name"), F.col("c_name"), F.lit("nation"), F.concat(F.lit("${var.name}"), F.col("c_nationkey").cast("string"))
    )
    return table(spark, d, "customer"), text, values


def fill_template(spark, d):
    customers, text, values = _templates(spark, d)
    return customers.select("c_custkey", x.fill_template(text, values).alias("filled"))


def undefined_vars(spark, d):
    customers, text, values = _templates(spark, d)
    return customers.select("c_custkey", F.array_join(x.undefined_variables(text, values), ",").alias("undefined"))


def command_prefixes(spark, d):
    commands = F.array(
        F.concat(F.lit("  dbt run --vars "), F.col("props")),
        F.when(F.col("event_type") == "error", "rm x").when(F.col("event_type") == "view", "edr report").otherwise("dbt test"),
    )
    return table(spark, d, "events").select("event_id", x.commands_have_prefix(commands).alias("allowed"))


def file_names(spark, d):
    path = F.when(F.col("url").endswith(".html"), F.regexp_replace("url", "html$", "yml")).otherwise(F.col("url"))
    return table(spark, d, "pages").select(
        "page_id", file_name(path).alias("name"), has_document_name(path).alias("is_document")
    )


def display_names(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "source")
    labelled = documents.join(table(spark, d, "labels"), "doc_id", "left")
    name = F.when(F.col("quality") == 1, F.col("source"))
    return labelled.select("doc_id", x.display_name(name, F.col("doc_id").cast("string"), "[jobs] ").alias("display_name"))


QUERIES = {
    "settings_keep": settings_keep,
    "settings_drop": settings_drop,
    "settings_default": settings_default,
    "json_states": json_states,
    "pause_default": pause_default,
    "placeholder_default": placeholder_default,
    "domain_fallback": domain_fallback,
    "parameters": parameters,
    "clean_keys": clean_keys,
    "fill_template": fill_template,
    "undefined_vars": undefined_vars,
    "command_prefixes": command_prefixes,
    "file_names": file_names,
    "display_names": display_names,
}

_K = "WITH e AS (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)"
_CLEAN = """CASE WHEN regexp_matches(raw_key, '^[^\\p{L}\\p{N}_]') AND cleaned <> '' THEN 'task_' || cleaned
                 ELSE cleaned END"""

SQL = {
    "settings_keep": _K + """
        SELECT event_id, '{"timeout_seconds":' || k || ',"_job_environments":["' || event_type || '"],"tags":{"owner":'
               || user_id || '}' || CASE WHEN k > 70 THEN ',"queue":{"enabled":' || (k > 85) || '}' ELSE '' END || '}'
               AS job_config FROM e""",
    "settings_drop": _K + """
        SELECT event_id, '{"timeout_seconds":' || k || CASE WHEN k > 50 THEN ',"scratch":true' ELSE '' END
               || CASE WHEN k > 70 THEN ',"queue":{"enabled":' || (k > 85) || '}' ELSE '' END || '}' AS config FROM e""",
    "settings_default": _K + """
        SELECT event_id, CASE WHEN k > 30 THEN CAST(k AS BIGINT) ELSE 7200 END AS timeout_seconds,
               1 AS max_concurrent_runs, CAST(NULL AS VARCHAR) AS queue FROM e""",
    "json_states": _K + """
        SELECT event_id, CASE WHEN k < 20 THEN 'object' WHEN k < 40 THEN 'array' WHEN k < 60 THEN 'broken'
                              WHEN k < 70 THEN 'scalar' WHEN k < 80 THEN 'null' ELSE 'missing' END AS state FROM e""",
    "pause_default": _K + """
        SELECT event_id,
               CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN NULL
                    WHEN k > 80 THEN 'PAUSED' WHEN k > 60 THEN 'UNPAUSED' WHEN event_type = 'view' THEN NULL
                    WHEN value > 50 THEN 'PAUSED' ELSE 'UNPAUSED' END AS pause_status,
               event_type NOT IN ('view', 'click', 'purchase') AND value <= 50 AS run_now FROM e""",
    "placeholder_default": """
        SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'shared' ELSE c_name END
               AS warehouse_id FROM customer""",
    "domain_fallback": """
        SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'ALL_DONE' WHEN '2-HIGH' THEN 'NONE_FAILED' END AS run_if,
               o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') AS warning,
               CASE WHEN o_orderstatus = 'F' THEN 'GIT' ELSE 'WORKSPACE' END AS file_source,
               CASE WHEN o_orderstatus = 'O' THEN 'EDITABLE' ELSE 'UI_LOCKED' END AS edit_mode FROM orders""",
    "parameters": _K + """
        SELECT event_id, CASE
            WHEN event_type = 'click' AND k < 30 THEN '["' || user_id || '","' || (value > 50) || '"]'
            WHEN event_type = 'click' AND k < 60 THEN '["click","x"]'
            WHEN event_type = 'click' THEN '[]'
            WHEN k < 30 THEN '{"user_id":"' || user_id || '","big":"' || (value > 50) || '"}'
            ELSE '{}' END AS parameters FROM e""",
    "clean_keys": """
        WITH keys AS (SELECT url AS raw_key FROM pages UNION ALL SELECT regexp_replace(url, '^https?:', '') FROM pages
                      UNION ALL SELECT p_brand || '__' || p_name || '_' FROM part),
             c AS (SELECT raw_key, trim(regexp_replace(regexp_replace(raw_key, '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')
                          AS cleaned FROM keys)
        SELECT raw_key, """ + _CLEAN + " AS cleaned_key FROM c",
    "fill_template": """
        SELECT c_custkey, CASE WHEN c_mktsegment <> 'FURNITURE'
               THEN c_name || '/${env}/${var.name}' || c_nationkey || c_name || '-' || c_mktsegment END AS filled
        FROM customer""",
    "undefined_vars": """
        SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'amount,date' ELSE '' END AS undefined FROM customer""",
    "command_prefixes": "SELECT event_id, event_type <> 'error' AS allowed FROM events",
    "file_names": """
        SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), 'html$', CASE WHEN url LIKE '%.html' THEN 'yml' ELSE 'html' END)
               AS name, url LIKE '%.html' AS is_document FROM pages""",
    "display_names": """
        SELECT doc_id, '[jobs] ' || CASE WHEN quality = 1 THEN source ELSE CAST(doc_id AS VARCHAR) END AS display_name
        FROM documents LEFT JOIN labels USING (doc_id)""",
}
