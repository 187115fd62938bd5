"""Change detection: by watermark, between snapshots, and against stored ids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.transform import newer_than

NULL_SPREAD = 1024


def changes_first(control: DataFrame, group: str = "resource_id") -> DataFrame:
    """Without a watermark every job is new."""
    return control.select(group).distinct().select(
        group, F.lit(None).cast("string").alias("task_key"), F.lit("new").alias("action")
    )


def changes_since(
    control: DataFrame,
    watermark,
    group: str = "resource_id",
    key: str = "task_key",
    created: str = "created_timestamp",
    updated: str = "updated_timestamp",
    disabled: str = "disabled",
) -> DataFrame:
    """(group, task_key, action) of what changed strictly after the watermark.

    A job with changed rows is `updated`, and `disabled` if one of them is; a task whose
    row was never changed since it was made is `new`. One scan, one aggregation.
    """
    changed = newer_than(control, updated, watermark)
    kind = control.schema[key].dataType
    nobody = F.lit(None).cast(kind)
    made = F.col(created) == F.col(updated)
    entries = F.array(
        F.struct(nobody.alias(key), F.lit("updated").alias("action")),
        F.struct(F.col(key).alias(key), F.when(made, "new").alias("action")),
        F.struct(nobody.alias(key), F.when(F.col(disabled), "disabled").alias("action")),
    )
    return changed.select(group, F.inline(entries)).filter("action IS NOT NULL").distinct()


def next_watermark(rows_read: DataFrame, updated: str = "updated_timestamp") -> DataFrame:
    """One row: the newest change among the rows read, so nothing in between is lost."""
    return rows_read.agg(F.max(updated).alias("watermark"))


def _keys_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(and_, [left[k] == right[k] for k in keys])


def deleted_keys(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the previous snapshot that the current one lacks."""
    return previous.select(*keys).join(current.select(*keys), list(keys), "left_anti")


def only_loaded(rows: DataFrame, loaded: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows of the groups that were loaded in this run."""
    return rows.join(loaded.select(*group), list(group), "left_semi")


def lookup_ids(
    rows: DataFrame, ids: DataFrame, key: str = "resource_id", value: str = "job_id"
) -> DataFrame:
    """Each row with its stored id, NULL when there is none. Ids are unique per key."""
    return rows.join(ids.select(key, value), key, "left")


def create_or_update(
    rows: DataFrame, ids: DataFrame, live: DataFrame, key: str = "resource_id", value: str = "job_id"
) -> DataFrame:
    """CREATE without a stored id, RECREATE when that id is no longer live, else UPDATE."""
    known = live.select(F.col(value)).distinct().withColumns({"_live": F.lit(True), "_spread": F.lit(0)})
    # Rows without an id match nothing, but would all be sent to one task by it.
    spread = F.when(F.col(value).isNull(), F.pmod(F.xxhash64(F.col(key)), F.lit(NULL_SPREAD)).cast("int")).otherwise(0)
    found = lookup_ids(rows, ids, key, value).withColumn("_spread", spread).join(known, [value, "_spread"], "left")
    action = (
        F.when(F.col(value).isNull(), "CREATE").when(F.col("_live").isNull(), "RECREATE").otherwise("UPDATE")
    )
    return found.withColumn("action", action).drop("_live", "_spread")


def file_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, action) of new, modified and deleted files, from (path, size, mtime) listings."""
    old = previous.select("path", F.struct("size", "mtime").alias("old"))
    new = current.select("path", F.struct("size", "mtime").alias("new"))
    action = (
        F.when(F.col("old").isNull(), "new")
        .when(F.col("new").isNull(), "deleted")
        .when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    )
    return old.join(new, "path", "full_outer").select("path", action.alias("action")).filter("action IS NOT NULL")


def changed_keys(*key_sets: DataFrame) -> DataFrame:
    """The union of key sets, each key once."""
    return reduce(lambda a, b: a.unionByName(b), key_sets).distinct()


def escalate(keys: DataFrame, all_keys: DataFrame, file_changes: DataFrame) -> DataFrame:
    """All keys when any file changed, else the given ones."""
    any_change = file_changes.agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
    return keys.unionByName(all_keys.select(*keys.columns).filter(any_change)).distinct()
