"""Conversations as dependency graphs: a conversation is a job, a turn is a task.

Every turn after the first depends on the turn in the middle before it, and answers
also on the turn they answer.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from millrace.operators import graph as g
from millrace.workload import table

GROUP, KEY = ["resource_id"], "task_key"


def _tasks(spark, d):
    half = F.floor(F.col("turn") / 2).cast("string")
    before = (F.col("turn") - 1).cast("string")
    deps = (
        F.when(F.col("turn") == 0, F.array().cast("array<string>"))
        .when(F.col("role") == "assistant", F.array(half, before))
        .otherwise(F.array(half))
    )
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("resource_id"), F.col("turn").cast("string").alias("task_key"), F.to_json(deps).alias("depends_on"),
        "role", F.length("text").alias("size"), "turn",
    )


def _back_edges(spark, d):
    """Conversations opened by the system: their first turn depends on their last one."""
    turns = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("resource_id")).agg(
        F.max("turn").alias("last"), F.min_by("role", "turn").alias("opened_by")
    )
    back = turns.filter((F.col("opened_by") == "system") & (F.col("last") > 0))
    return back.select("resource_id", F.lit("0").alias("task_key"), F.col("last").cast("string").alias("dep_key"))


def _next_edges(spark, d):
    """Every turn depends on the next one, which the last turn does not have."""
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("resource_id"), F.col("turn").cast("string").alias("task_key"),
        (F.col("turn") + 1).cast("string").alias("dep_key"),
    )


def dag_edges(spark, d):
    return g.dependency_edges(_tasks(spark, d))


def dag_roots(spark, d):
    tasks = _tasks(spark, d)
    return g.root_tasks(tasks, g.dependency_edges(tasks), GROUP, KEY)


def dag_levels(spark, d):
    tasks = _tasks(spark, d)
    return g.topological_levels(tasks, g.dependency_edges(tasks), GROUP, KEY)


def dag_missing(spark, d):
    return g.missing_dependencies(_tasks(spark, d), _next_edges(spark, d), GROUP, KEY)


def dag_self(spark, d):
    half = table(spark, d, "conversations").select(
        F.col("conv_id").alias("resource_id"), F.col("turn").cast("string").alias("task_key"),
        F.floor(F.col("turn") / 2).cast("string").alias("dep_key"),
    )
    return g.self_dependencies(half, KEY)


def _levels_with_cycles(spark, d):
    tasks = _tasks(spark, d)
    edges = g.dependency_edges(tasks).unionByName(_back_edges(spark, d))
    return g.topological_levels(tasks, edges, GROUP, KEY)


def dag_levels_cyclic(spark, d):
    return _levels_with_cycles(spark, d)


def dag_cycles(spark, d):
    return g.cyclic_groups(_levels_with_cycles(spark, d), GROUP)


def dag_cycle_members(spark, d):
    """Turns on a cycle; those that merely wait for one are not."""
    tasks = _tasks(spark, d)
    edges = g.dependency_edges(tasks).unionByName(_back_edges(spark, d))
    return g.cycle_members(tasks, edges, GROUP, KEY)


def dag_levels_deep(spark, d):
    """Order lines of a supplier as one chain, far longer than a batch."""
    lines = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("resource_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("task_key")
    )
    before = F.lag("task_key").over(Window.partitionBy("resource_id").orderBy("task_key"))
    chain = lines.distinct().withColumn("dep_key", before)
    return g.topological_levels(lines, chain.filter("dep_key IS NOT NULL"), GROUP, KEY, batch=100)


def run_if(spark, d):
    run = (
        F.when(F.col("role") == "assistant", "NONE_FAILED")
        .when(F.col("turn") >= 6, "AT_LEAST_ONE_FAILED")
        .when(F.col("turn") >= 4, "ALL_DONE")
        .when(F.col("turn") >= 2, "AT_LEAST_ONE_SUCCESS")
    )
    tasks = _tasks(spark, d).withColumns({"run_if": run, "disabled": F.col("size") > 1500})
    outcome = F.when(F.col("size") < 80, "FAILED").when(F.col("size") < 160, "SKIPPED").otherwise("SUCCESS")
    outcomes = tasks.filter(F.col("size") < 1200).select("resource_id", "task_key", outcome.alias("outcome"))
    return g.run_decisions(tasks, g.dependency_edges(tasks), outcomes, GROUP, KEY)


QUERIES = {
    "dag_edges": dag_edges,
    "dag_roots": dag_roots,
    "dag_levels": dag_levels,
    "dag_missing": dag_missing,
    "dag_self": dag_self,
    "dag_levels_cyclic": dag_levels_cyclic,
    "dag_cycles": dag_cycles,
    "dag_cycle_members": dag_cycle_members,
    "dag_levels_deep": dag_levels_deep,
    "run_if": run_if,
}

_EDGES = """
    n AS (SELECT conv_id AS resource_id, turn, role, length(text) AS size FROM conversations),
    e AS (SELECT resource_id, turn AS task, turn // 2 AS dep FROM n WHERE turn > 0
          UNION SELECT resource_id, turn, turn - 1 FROM n WHERE turn > 0 AND role = 'assistant')
"""
_WALK = """
    walk AS (SELECT resource_id, turn, 0 AS level FROM n WHERE turn = 0
             UNION SELECT e.resource_id, e.task, walk.level + 1
             FROM e JOIN walk ON e.resource_id = walk.resource_id AND e.dep = walk.turn)
"""
_OPENED = """
    opened AS (SELECT resource_id, max(turn) AS last FROM n GROUP BY 1
               HAVING min_by(role, turn) = 'system' AND max(turn) > 0),
    reach AS (SELECT o.resource_id, o.last AS turn FROM opened o
              UNION SELECT e.resource_id, e.dep FROM e JOIN reach r ON r.resource_id = e.resource_id AND e.task = r.turn),
    cyclic AS (SELECT DISTINCT resource_id FROM reach WHERE turn = 0)
"""

SQL = {
    "dag_edges": f"""WITH {_EDGES}
        SELECT resource_id, CAST(task AS VARCHAR) AS task_key, CAST(dep AS VARCHAR) AS dep_key FROM e""",
    "dag_roots": "SELECT DISTINCT conv_id AS resource_id, CAST(turn AS VARCHAR) AS task_key FROM conversations WHERE turn = 0",
    "dag_levels": f"""WITH RECURSIVE {_EDGES}, {_WALK}
        SELECT resource_id, CAST(turn AS VARCHAR) AS task_key, CAST(max(level) AS INTEGER) AS level FROM walk GROUP BY 1, 2""",
    "dag_missing": """
        SELECT conv_id AS resource_id, CAST(turn AS VARCHAR) AS task_key, CAST(turn + 1 AS VARCHAR) AS dep_key
        FROM conversations c
        WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = c.turn + 1)""",
    "dag_self": """
        SELECT conv_id AS resource_id, CAST(turn AS VARCHAR) AS task_key, CAST(turn AS VARCHAR) AS dep_key
        FROM conversations WHERE turn // 2 = turn""",
    "dag_levels_cyclic": f"""WITH RECURSIVE {_EDGES}, {_WALK}, {_OPENED}
        SELECT resource_id, CAST(turn AS VARCHAR) AS task_key,
               CASE WHEN resource_id NOT IN (SELECT resource_id FROM cyclic) THEN CAST(max(level) AS INTEGER) END AS level
        FROM walk GROUP BY 1, 2""",
    "dag_cycle_members": f"""WITH RECURSIVE {_EDGES}, {_OPENED}
        SELECT resource_id, CAST(turn AS VARCHAR) AS task_key, '0' AS cycle FROM reach
        WHERE resource_id IN (SELECT resource_id FROM cyclic)""",
    "dag_levels_deep": """
        SELECT l_suppkey AS resource_id, task_key,
               CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY task_key) - 1 AS INTEGER) AS level
        FROM (SELECT DISTINCT l_suppkey, l_orderkey * 8 + l_linenumber AS task_key FROM lineitem)""",
    "dag_cycles": f"WITH RECURSIVE {_EDGES}, {_OPENED} SELECT resource_id FROM cyclic",
    "run_if": f"""WITH {_EDGES},
        o AS (SELECT resource_id, turn, CASE WHEN size > 1500 THEN 'DISABLED' WHEN size >= 1200 THEN NULL
                     WHEN size < 80 THEN 'FAILED' WHEN size < 160 THEN 'SKIPPED' ELSE 'SUCCESS' END AS outcome FROM n),
        c AS (SELECT e.resource_id, e.task, count(*) AS n, count(outcome) AS done,
                     count(*) FILTER (WHERE outcome IN ('SUCCESS', 'DISABLED')) AS ok,
                     count(*) FILTER (WHERE outcome = 'FAILED') AS failed
              FROM e JOIN o ON o.resource_id = e.resource_id AND o.turn = e.dep GROUP BY 1, 2)
        SELECT n.resource_id, CAST(n.turn AS VARCHAR) AS task_key,
               CASE WHEN size > 1500 THEN 'DISABLED' WHEN c.n IS NULL THEN 'RUN' WHEN done < c.n THEN 'WAIT'
                    WHEN CASE WHEN role = 'assistant' THEN failed = 0 WHEN n.turn >= 6 THEN failed > 0
                              WHEN n.turn >= 4 THEN true WHEN n.turn >= 2 THEN ok > 0 ELSE ok = c.n END
                    THEN 'RUN' ELSE 'SKIP' END AS decision
        FROM n LEFT JOIN c ON c.resource_id = n.resource_id AND c.task = n.turn""",
}
