"""Row rules, key rules, quarantine by group and all-or-nothing gates.

Reasons are short codes from a fixed list, so collecting the codes of a group is
bounded by the number of rules, whatever the size of the group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.json import dependency_list
from millrace.functions.text import clean_key, commands_have_prefix
from millrace.operators.settings import without_placeholder

# Task types and the fields each of them needs ("a|b": one of them).
REQUIRED_FIELDS = {
    "notebook": ("file_path",),
    "sql_query": ("sql_query|query_id",),
    "sql_file": ("file_path",),
    "python_wheel": ("package_name", "entry_point"),
    "spark_jar": ("main_class_name",),
    "pipeline": ("pipeline_id",),
    "dbt": ("commands",),
}
TASK_TYPES = tuple(REQUIRED_FIELDS)
WAREHOUSE_TYPES = ("sql_query", "sql_file")
COMMAND_TYPE = "dbt"


def blank(value: Column) -> Column:
    return value.isNull() | (value.cast("string") == "")


def unset(setting: Column) -> Column:
    """True for settings, as JSON text, that are missing or empty."""
    return setting.isNull() | setting.isin("", "[]", "{}")


def reasons(rules: Mapping[str, Column]) -> Column:
    """Codes of the rules a row breaks; a rule that is NULL is not broken.

    concat_ws drops the NULLs inside generated code; only rows with codes are split.
    """
    joined = F.concat_ws("\n", *[F.when(broken, F.lit(code)) for code, broken in rules.items()])
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, "\n"))


def with_reasons(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return df.withColumn("reasons", reasons(rules))


def repeated_keys(df: DataFrame, keys: Sequence[str], where: str | None = None) -> DataFrame:
    """Keys that occur more than once, with their count and, if asked, in how many places."""
    measures = [F.count(F.lit(1)).alias("copies")]
    if where:
        measures.append(F.count_distinct(where).alias("places"))
    return df.groupBy(*keys).agg(*measures).filter(F.col("copies") > 1)


def missing_required(columns: Sequence[str]) -> dict[str, Column]:
    """One rule per column that must be present and not empty."""
    return {f"missing:{name}": blank(F.col(name)) for name in columns}


def known_type(task_type: Column) -> Column:
    return task_type.isin(*TASK_TYPES)


def type_rules(task_type: Column, fields: Column, default_warehouse: Column | None = None) -> dict[str, Column]:
    """Rules on the type and on the fields it needs, over settings parsed to map<string,string>."""
    fallback = default_warehouse if default_warehouse is not None else F.lit(None).cast("string")
    field_of = lambda name: F.try_element_at(fields, F.lit(name))
    rules = {"unknown_type": ~known_type(task_type)}
    for kind, names in REQUIRED_FIELDS.items():
        for name in names:
            absent = [unset(field_of(choice)) for choice in name.split("|")]
            rules[f"{kind}:missing:{name}"] = (task_type == kind) & reduce(and_, absent)
    warehouse = without_placeholder(field_of("warehouse_id"), fallback)
    rules["missing:warehouse_id"] = task_type.isin(*WAREHOUSE_TYPES) & blank(warehouse)
    text = field_of("commands")
    commands = F.coalesce(F.from_json(text, "array<string>"), F.array(text))
    rules["bad_command"] = (task_type == COMMAND_TYPE) & ~unset(text) & ~commands_have_prefix(commands)
    return rules


def with_type_reasons(
    tasks: DataFrame,
    task_type: str = "task_type",
    config: str = "task_config",
    default_warehouse: Column | None = None,
) -> DataFrame:
    """Add the reasons of type_rules; the JSON settings of a row are parsed once for all rules."""
    parsed = tasks.withColumn("_fields", F.from_json(config, "map<string,string>"))
    return with_reasons(parsed, type_rules(F.col(task_type), F.col("_fields"), default_warehouse)).drop("_fields")


def dependency_rules(value: Column, given: Column) -> dict[str, Column]:
    """Rules on a dependency list: valid JSON (value is parsed, given its text), and an array of strings."""
    return {
        "broken_depends_on": given.isNotNull() & value.isNull(),
        "depends_on_not_a_list_of_keys": value.isNotNull() & dependency_list(value).isNull(),
    }


def with_dependency_reasons(tasks: DataFrame, depends_on: str = "depends_on") -> DataFrame:
    """Add the reasons of dependency_rules; the text of a row is parsed once."""
    parsed = tasks.withColumn("_value", F.try_parse_json(depends_on))
    return with_reasons(parsed, dependency_rules(F.col("_value"), F.col(depends_on))).drop("_value")


def key_collisions(tasks: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """(group, cleaned_key, keys) for cleaned keys that stand for several task keys."""
    return (
        tasks.select(*group, F.col(key)).distinct()
        .groupBy(*group, clean_key(F.col(key)).alias("cleaned_key"))
        .agg(F.count(F.lit(1)).alias("keys"))
        .filter(F.col("keys") > 1)
    )


def colliding_keys(tasks: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """(group, key): the tasks whose cleaned key another key of their group has as well."""
    named = tasks.select(*group, key, clean_key(F.col(key)).alias("cleaned_key"))
    return named.join(key_collisions(tasks, group, key), [*group, "cleaned_key"], "left_semi").select(*group, key).distinct()


def failed_rows(checked: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, reason), each once: why a group is rejected."""
    return checked.filter(F.size("reasons") > 0).select(*group, F.explode("reasons").alias("reason")).distinct()


def quarantine(checked: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows): one bad row rejects its whole group.

    Bad groups are reduced to distinct keys first and then joined to the rows by semi
    and anti joins, whose row side AQE can split, so a large group stays spread out.
    """
    bad = checked.filter(F.size("reasons") > 0).select(*group).distinct()
    rejected = checked.join(bad, list(group), "left_semi")
    accepted = checked.join(bad, list(group), "left_anti").drop("reasons")
    return accepted, rejected


def rejected_groups(checked: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, bad_rows, reasons) per rejected group; the codes are bounded by the rules."""
    bad = checked.filter(F.size("reasons") > 0)
    counts = bad.groupBy(*group).agg(F.count(F.lit(1)).alias("bad_rows"))
    codes = failed_rows(checked, group).groupBy(*group).agg(
        F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons")
    )
    return counts.join(codes, list(group))


def all_or_nothing(checked: DataFrame) -> DataFrame:
    """All rows, or none of them if any row breaks a rule. The verdict is one scalar subquery."""
    clean = checked.agg(
        F.coalesce(F.bool_and(F.size("reasons") == 0), F.lit(True)).alias("clean")
    ).scalar()
    return checked.filter(clean).drop("reasons")


def load_summary(accepted: DataFrame, rejected: DataFrame, group: str, actions: DataFrame | None = None) -> DataFrame:
    """One row: tasks and jobs loaded, jobs that failed, and tasks deleted by the merge whose actions are given."""
    loaded = accepted.agg(
        F.count(F.lit(1)).alias("tasks_loaded"), F.count_distinct(group).alias("jobs_loaded")
    )
    failed = rejected.agg(F.count_distinct(group).alias("n")).scalar()
    loaded = loaded.withColumn("jobs_failed", failed)
    if actions is None:
        return loaded
    deleted = actions.agg(F.count_if(F.col("action") == "delete").alias("n")).scalar()
    return loaded.withColumn("tasks_deleted", deleted)


def run_outcomes(results: DataFrame, group: str, error: str = "error") -> DataFrame:
    """(group, status, error), a row for each group: `failed` with its first error in order, or `succeeded`."""
    first = results.groupBy(group).agg(F.min(error).alias("error"))
    return first.select(group, _status(F.col("error")).alias("status"), "error")


def run_summary(results: DataFrame, error: str = "error") -> DataFrame:
    """Groups per status: `succeeded` without an error, `failed` with one."""
    return results.groupBy(_status(F.col(error)).alias("status")).agg(F.count(F.lit(1)).alias("jobs"))


def _status(error: Column) -> Column:
    return F.when(error.isNull(), "succeeded").otherwise("failed")


def load_status(counts: DataFrame) -> DataFrame:
    """SUCCESS when the target grew by exactly the kept rows, else FAILED; from write counts.

    Counts without rows_before are those of a target that was empty or overwritten.
    """
    before = F.col("rows_before") if "rows_before" in counts.columns else F.lit(0)
    complete = F.col("rows_in_target") - before == F.col("rows_kept")
    return counts.select(
        F.lit("data_validation").alias("validation_type"),
        F.when(complete, "SUCCESS").otherwise("FAILED").alias("status"),
        "rows_read",
        "rows_kept",
        "rows_in_target",
    )
