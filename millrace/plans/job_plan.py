"""The plan of what to do with every job of the control table, as one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.json import parse_dependencies
from millrace.functions.text import clean_key, display_name
from millrace.operators.changes import create_or_update
from millrace.operators.graph import dependency_edges, topological_levels
from millrace.operators.ranking import first_per_key
from millrace.operators.settings import (
    NUMBERS_OF_TASKS,
    TRIGGER_KINDS,
    edit_mode,
    file_source,
    normalised_parameters,
    number_rules,
    pause_status,
    setting,
    starts_at_once,
    with_job_settings,
    with_task_settings,
    without_placeholder,
)
from millrace.operators.validate import colliding_keys, reasons, with_type_reasons

GROUP, KEY = "resource_id", "task_key"


def job_plan(control: DataFrame, ids: DataFrame, live: DataFrame, paused: bool = False, prefix: str = "") -> DataFrame:
    """One row per job: CREATE, RECREATE or UPDATE, with its settings and pause status."""
    heads = first_per_key(control, [GROUP], [F.col(KEY)]).select(GROUP, "job_name", "job_config")
    jobs = with_job_settings(create_or_update(heads, ids, live))
    is_new = F.col("action") != "UPDATE"
    has_trigger = F.coalesce(*[F.col(kind) for kind in TRIGGER_KINDS]).isNotNull()
    explicit = F.coalesce(*[F.get_json_object(kind, "$.pause_status") for kind in TRIGGER_KINDS])
    return jobs.withColumns(
        {
            "display_name": display_name(F.col("job_name"), F.col(GROUP), prefix),
            "edit_mode": edit_mode(F.col("edit_mode")),
            "pause_status": pause_status(is_new, has_trigger, explicit, F.lit(paused)),
            "run_now": starts_at_once(is_new, has_trigger, F.lit(paused)),
            "job_id": F.when(F.col("action") == "UPDATE", F.col("job_id")),
        }
    ).drop("job_config")


def task_plan(control: DataFrame, default_warehouse: Column | None = None) -> DataFrame:
    """One row per task with its level: cleaned key and dependencies, settings, parameters, reasons.

    A task with reasons cannot run, and neither can its job; a NULL level means a cycle.
    """
    warehouse = default_warehouse if default_warehouse is not None else F.lit(None).cast("string")
    config = F.col("task_config")
    levels = topological_levels(control, dependency_edges(control), [GROUP], KEY)
    collisions = colliding_keys(control, [GROUP], KEY).withColumn("_collides", F.lit(True))
    extra = reasons({
        "cleaned_key_collision": F.col("_collides"),
        **number_rules(F.from_json(config, "map<string,variant>"), NUMBERS_OF_TASKS),
    })
    return (
        with_type_reasons(with_task_settings(control), default_warehouse=warehouse)
        .join(collisions, [GROUP, KEY], "left")
        .withColumn("reasons", F.concat("reasons", extra))
        .drop("_collides")
        .withColumn("_needs", parse_dependencies(F.col("depends_on")))
        .withColumns(
            {
                "cleaned_key": clean_key(F.col(KEY)),
                "cleaned_depends_on": F.array_distinct(F.transform("_needs", clean_key)),
                "warehouse_id": without_placeholder(setting(config, "warehouse_id"), warehouse),
                "file_source": file_source(setting(config, "file_source")),
                "parameters": normalised_parameters(F.col("task_type"), setting(config, "parameters")),
            }
        )
        .drop("_needs")
        .join(levels, [GROUP, KEY], "left")
    )
