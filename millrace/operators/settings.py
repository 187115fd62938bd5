"""Job and task settings: which keys are kept, defaults, domains, parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.json import drop_keys, keep_keys, parameters_as_list, parameters_as_strings

# Setting names, defaults and value domains of the control tables.
JOB_KEYS = (
    "description",
    "tags",
    "environments",
    "parameters",
    "timeout_seconds",
    "max_concurrent_runs",
    "queue",
    "continuous",
    "trigger",
    "schedule",
    "job_clusters",
    "notification_settings",
    "edit_mode",
)
JOB_KEY_RENAMES = {"environments": "_job_environments"}
TASK_COLUMNS = ("task_key", "task_type", "depends_on", "disabled")
NUMBERS_OF_JOBS, NUMBERS_OF_TASKS = ("timeout_seconds", "max_concurrent_runs"), ("timeout_seconds",)
NOT_PLANNED = ("description",)
JOB_TIMEOUT_SECONDS = 7200
TASK_TIMEOUT_SECONDS = 3600
MAX_CONCURRENT_RUNS = 1
TRIGGER_KINDS = ("continuous", "schedule", "trigger")
WAREHOUSE_PLACEHOLDERS = ("your-warehouse-id", "your_warehouse_id")
RUN_CONDITIONS = (
    "ALL_SUCCESS",
    "AT_LEAST_ONE_SUCCESS",
    "NONE_FAILED",
    "ALL_DONE",
    "AT_LEAST_ONE_FAILED",
    "ALL_FAILED",
)
FILE_SOURCES = ("WORKSPACE", "GIT")
DEFAULT_FILE_SOURCE = "WORKSPACE"
LOCKED, EDITABLE = "UI_LOCKED", "EDITABLE"
LIST_PARAMETER_TYPES = ("python_wheel", "spark_jar")


def job_settings(job: Column) -> Column:
    """JSON text of the job-level keys of a job's settings map."""
    return F.coalesce(F.to_json(keep_keys(job, JOB_KEYS, JOB_KEY_RENAMES)), F.lit("{}"))


def task_settings(task: Column) -> Column:
    """JSON text of a task's settings map without the keys that have columns of their own."""
    return F.coalesce(F.to_json(drop_keys(task, TASK_COLUMNS)), F.lit("{}"))


def setting(config: Column, key: str, kind: str = "string") -> Column:
    """One top-level setting; objects and arrays come as JSON text."""
    value = F.get_json_object(config, f"$.{key}")
    return value if kind == "string" else value.try_cast(kind)


def number_rules(settings: Column, names: Sequence[str]) -> dict[str, Column]:
    """A rule per setting, of a map of variants, that is given but is no whole number."""
    rules = {}
    for name in names:
        value = F.try_element_at(settings, F.lit(name))
        given = value.isNotNull() & ~F.is_variant_null(value)
        rules[f"bad_value:{name}"] = given & F.try_variant_get(value, "$", "bigint").isNull()
    return rules


def with_job_settings(jobs: DataFrame, config: str = "job_config") -> DataFrame:
    """Add one column per job setting: a default where there is one, else NULL."""
    text = F.col(config)
    columns = {
        "timeout_seconds": F.coalesce(setting(text, "timeout_seconds", "bigint"), F.lit(JOB_TIMEOUT_SECONDS)),
        "max_concurrent_runs": F.coalesce(setting(text, "max_concurrent_runs", "bigint"), F.lit(MAX_CONCURRENT_RUNS)),
        "environments": setting(text, "_job_environments"),
    }
    for key in JOB_KEYS:
        if key not in columns and key not in NOT_PLANNED:
            columns[key] = setting(text, key)
    return jobs.withColumns(columns)


def with_task_settings(tasks: DataFrame, config: str = "task_config") -> DataFrame:
    """Add a task's timeout, run condition and disabled flag with their defaults."""
    text = F.col(config)
    return tasks.withColumns(
        {
            "task_timeout_seconds": F.coalesce(setting(text, "timeout_seconds", "bigint"), F.lit(TASK_TIMEOUT_SECONDS)),
            "run_if": run_condition(setting(text, "run_if")),
            "disabled": F.coalesce(F.col("disabled"), F.lit(False)),
        }
    )


def pause_status(is_new: Column, has_setting: Column, explicit: Column, paused: Column) -> Column:
    """The explicit value; for new jobs with a trigger, else the default; otherwise NULL."""
    return (
        F.when(~has_setting, F.lit(None).cast("string"))
        .when(explicit.isNotNull(), explicit)
        .when(is_new, F.when(paused, "PAUSED").otherwise("UNPAUSED"))
    )


def starts_at_once(is_new: Column, has_setting: Column, paused: Column) -> Column:
    """New jobs without any trigger run once when made, unless made paused."""
    return is_new & ~has_setting & ~paused


def without_placeholder(value: Column, default: Column, placeholders=WAREHOUSE_PLACEHOLDERS) -> Column:
    """The value unless it is a placeholder (in any case) or empty, then the default."""
    real = F.when((value != "") & ~F.lower(value).isin(*placeholders), value)
    return F.coalesce(real, default)


def in_domain(value: Column, domain, fallback: str | None = None) -> Column:
    return F.when(value.isin(*domain), value).otherwise(F.lit(fallback))


def outside_domain(value: Column, domain) -> Column:
    """True for values that are given but unknown."""
    return F.coalesce(~value.isin(*domain), F.lit(False))


def run_condition(value: Column) -> Column:
    """A known run condition, else NULL."""
    return in_domain(value, RUN_CONDITIONS)


def file_source(value: Column) -> Column:
    return in_domain(value, FILE_SOURCES, DEFAULT_FILE_SOURCE)


def edit_mode(value: Column) -> Column:
    """Locked when absent or said so, editable for any other value."""
    return F.when(F.coalesce(value, F.lit(LOCKED)) == LOCKED, LOCKED).otherwise(EDITABLE)


def normalised_parameters(task_type: Column, parameters: Column) -> Column:
    """JSON text of parameters: a list for list-type tasks, an object of strings for the others."""
    return F.when(
        task_type.isin(*LIST_PARAMETER_TYPES), F.to_json(parameters_as_list(parameters))
    ).otherwise(F.to_json(parameters_as_strings(parameters)))
