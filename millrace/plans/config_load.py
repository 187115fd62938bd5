"""Loading configuration documents into the control table, for all jobs at once.

documents -> jobs (json_jobs / yaml_jobs) -> task rows -> reasons -> merge.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import display_name, fill_template
from millrace.operators.graph import (
    cyclic_groups,
    dependency_edges,
    edges_by_presence,
    self_dependencies,
    topological_levels,
)
from millrace.operators.merge import Audit, action_counts, reconcile
from millrace.operators.settings import NUMBERS_OF_JOBS, NUMBERS_OF_TASKS, job_settings, number_rules, task_settings
from millrace.operators.validate import blank, colliding_keys, dependency_rules, reasons, repeated_keys, with_type_reasons
from millrace.schemas import CONTROL, CONTROL_KEYS
from millrace.sources.staging import stage

GROUP, KEY = "resource_id", "task_key"


def job_rows(jobs: DataFrame, variables: Mapping[str, Any] | Column | None = None) -> DataFrame:
    """(path, resource_id, job, tasks, job_reasons): templates filled, the job parsed to a settings map."""
    variables = variables if variables is not None else {}
    filled = jobs.select(
        "path",
        "reason",
        F.col(GROUP).alias("_id"),
        fill_template(F.col(GROUP), variables).alias(GROUP),
        F.col("job").isNotNull().alias("_given"),
        fill_template(F.col("job"), variables).alias("_text"),
    )
    parsed = filled.withColumn("job", F.from_json("_text", "map<string,variant>"))
    listed = parsed.withColumn(
        "tasks", F.try_variant_get(F.try_element_at("job", F.lit("tasks")), "$", "array<variant>")
    )
    unknown = F.col("_given") & (F.col("_text").isNull() | F.col(GROUP).isNull())
    rules = {
        "undefined_variable": unknown,
        "job_not_a_mapping": F.col("_given") & F.col("_text").isNotNull() & F.col("job").isNull(),
        "no_tasks": F.col("job").isNotNull() & (F.coalesce(F.size("tasks"), F.lit(0)) < 1),
        **number_rules(F.col("job"), NUMBERS_OF_JOBS),
    }
    return listed.select(
        "path",
        F.coalesce(GROUP, "_id").alias(GROUP),
        "job",
        "tasks",
        F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(reasons(rules)).alias("job_reasons"),
    )


def _text(task: Column, key: str) -> Column:
    return F.try_variant_get(task, f"$.{key}", "string")


def task_rows(jobs: DataFrame) -> DataFrame:
    """One control row per task, with the reasons of its job and its own."""
    job = F.col("job")
    name = F.try_variant_get(F.try_element_at(job, F.lit("name")), "$", "string")
    named = jobs.select(
        "path",
        GROUP,
        display_name(name, F.col(GROUP)).alias("job_name"),
        job_settings(job).alias("job_config"),
        "job_reasons",
        "tasks",
    )
    task = F.col("task")
    tasks = named.withColumn("task", F.explode_outer("tasks")).withColumns(
        {
            "_settings": F.try_variant_get(task, "$", "map<string,variant>"),
            KEY: _text(task, "task_key"),
            "task_type": _text(task, "task_type"),
            "_deps": F.try_variant_get(task, "$.depends_on", "variant"),
        }
    )
    deps, there = F.col("_deps"), task.isNotNull()
    own = {
        "missing:task_key": there & blank(F.col(KEY)),
        "missing:task_type": there & blank(F.col("task_type")),
        **dependency_rules(deps, deps),
        **number_rules(F.col("_settings"), NUMBERS_OF_TASKS),
    }
    return tasks.select(
        "path",
        GROUP,
        "job_name",
        KEY,
        F.when(deps.isNull() | F.is_variant_null(deps), "[]").otherwise(F.to_json(deps)).alias("depends_on"),
        "task_type",
        "job_config",
        task_settings(F.col("_settings")).alias("task_config"),
        F.coalesce(F.try_variant_get(task, "$.disabled", "boolean"), F.lit(False)).alias("disabled"),
        F.concat("job_reasons", reasons(own)).alias("reasons"),
    )


def graph_reasons(rows: DataFrame) -> DataFrame:
    """(path, resource_id, task_key, reason): row reasons, repeated keys and graph errors."""
    tasks = rows.filter(F.col(KEY).isNotNull())
    # Parsed and looked up once: missing and self-dependencies and the levels all read them.
    edges = stage(edges_by_presence(tasks, dependency_edges(tasks), [GROUP], KEY), "edges")
    known = edges.filter("known").drop("known")
    found = rows.select("path", GROUP, KEY, F.explode("reasons").alias("reason"))

    def add(problems: DataFrame, reason: str) -> DataFrame:
        columns = [F.col(c) if c in problems.columns else F.lit(None).cast("string").alias(c) for c in ("path", GROUP, KEY)]
        return problems.select(*columns, F.lit(reason).alias("reason"))

    cycles = cyclic_groups(topological_levels(tasks, known, [GROUP], KEY, known=True), [GROUP])
    several = repeated_keys(rows.select(GROUP, "path").distinct(), [GROUP])
    return (
        found.unionByName(add(repeated_keys(tasks, [GROUP, KEY]), "repeated_task_key"))
        .unionByName(add(several, "repeated_resource_id"))
        .unionByName(add(colliding_keys(tasks, [GROUP], KEY), "cleaned_key_collision"))
        .unionByName(add(edges.filter("NOT known"), "missing_dependency"))
        .unionByName(add(self_dependencies(edges, KEY), "self_dependency"))
        .unionByName(add(cycles, "cycle"))
        .distinct()
    )


@dataclass(frozen=True)
class Load:
    """The new control table with its actions, the reasons for what was left out, and a summary."""

    merged: DataFrame
    problems: DataFrame
    accepted: DataFrame
    rejected: bool = False  # all of it: the table is as it was

    @property
    def table(self) -> DataFrame:
        return self.merged.filter(F.col("action") != "delete").drop("action")

    @property
    def counts(self) -> DataFrame:
        return action_counts(self.merged)


def _prepared(
    jobs: DataFrame, variables: Mapping[str, Any] | Column | None, strict: bool, warehouse: Column | None
) -> tuple[DataFrame, DataFrame]:
    rows = task_rows(job_rows(jobs, variables))
    if strict:
        own = rows.withColumnRenamed("reasons", "_own")
        typed = F.when(F.col("task_type").isNull(), F.array().cast("array<string>")).otherwise(F.col("reasons"))
        rows = with_type_reasons(own, default_warehouse=warehouse).withColumn("reasons", F.concat("_own", typed)).drop("_own")
    # Rows are read by every check and by the merge: parsed once, then staged.
    rows = stage(rows, "task-rows")
    return rows, stage(graph_reasons(rows), "problems")


def _merged(control: DataFrame, accepted: DataFrame, as_of: Column, user: Column, scope: str) -> DataFrame:
    source = accepted.select([f.name for f in CONTROL.fields if f.name in accepted.columns])
    where = "all" if scope == "all" else [GROUP]
    return reconcile(
        control, source, CONTROL_KEYS, where, audit=Audit(as_of, user), keep_deleted=True, with_action=True,
        staged=True, unique=True,  # a filter of staged rows, without those of repeated keys
    )


def load_isolated(
    control: DataFrame,
    jobs: DataFrame,
    as_of: Column,
    user: Column,
    variables: Mapping[str, Any] | Column | None = None,
    scope: str = "touched",
    strict: bool = False,
    default_warehouse: Column | None = None,
) -> Load:
    """Load every sound job; a job with any problem is left out whole and its rows stay as they were."""
    rows, problems = _prepared(jobs, variables, strict, default_warehouse)
    bad = problems.filter(F.col(GROUP).isNotNull()).select(GROUP).distinct()
    accepted = rows.filter(F.col(KEY).isNotNull()).join(bad, GROUP, "left_anti").drop("reasons")
    return Load(_merged(control, accepted, as_of, user, scope), problems, accepted)


def load_atomic(
    control: DataFrame,
    jobs: DataFrame,
    as_of: Column,
    user: Column,
    variables: Mapping[str, Any] | Column | None = None,
    scope: str = "touched",
    strict: bool = False,
    default_warehouse: Column | None = None,
) -> Load:
    """Load everything, or leave the table as it was if any document has a problem; then nothing is merged."""
    rows, problems = _prepared(jobs, variables, strict, default_warehouse)
    accepted = rows.filter(F.col(KEY).isNotNull()).drop("reasons")
    if problems.isEmpty():
        return Load(_merged(control, accepted, as_of, user, scope), problems, accepted)
    return Load(control.withColumn("action", F.lit("keep")), problems, accepted.limit(0), rejected=True)
