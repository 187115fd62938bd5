"""The control table and its id table as one object: load, look up, detect changes, plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators.changes import changes_first, changes_since, escalate, file_diff, only_loaded
from millrace.operators.merge import Audit, insert_rows, update_where, upsert_ids
from millrace.operators.transform import equals
from millrace.operators.validate import load_summary
from millrace.plans.config_load import Load, load_atomic, load_isolated
from millrace.plans.job_plan import job_plan, task_plan
from millrace.sinks.tables import create_control_table, create_id_map_table, overwrite, replace_own_source
from millrace.sources.documents import YAML_GLOB, read_documents, yaml_jobs
from millrace.sources.files import list_files
from millrace.sources.staging import stage


@dataclass(frozen=True)
class Report:
    """What a load did: one summary row, rows per action, and the problems found."""

    summary: DataFrame
    actions: DataFrame
    problems: DataFrame


@dataclass(frozen=True)
class Sync:
    """What a poll found and did.

    files    (path, action) of files that are new, modified or deleted since the listing before
    report   of the load, None if no file changed and nothing was loaded
    changes  (resource_id, task_key, action) of the control table since the watermark
    plan     what to do with the jobs concerned: all if a file changed, else the changed ones
    listing, watermark   what the next poll starts from
    """

    files: DataFrame
    report: Report | None
    changes: DataFrame
    plan: DataFrame
    listing: DataFrame
    watermark: Any


class ControlTable:
    """Operations on a control table by name. Times and users are parameters with the obvious defaults."""

    def __init__(self, spark: SparkSession, name: str, ids: str | None = None):
        if not name:
            raise ValueError("the control table needs a name")
        self.spark, self.name, self.ids = spark, name, ids or f"{name}_jobs"

    def ensure(self) -> ControlTable:
        create_control_table(self.spark, self.name)
        create_id_map_table(self.spark, self.ids)
        return self

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def load_document(self, path: str, variables: Mapping[str, Any] | None = None, **options) -> Report:
        """Load one document, or a folder of them, job by job: unsound jobs are left out."""
        return self._load(load_isolated, path, variables, **options)

    def load_folder(self, path: str, variables: Mapping[str, Any] | None = None, **options) -> Report:
        """Load all documents of a folder, or none of them."""
        return self._load(load_atomic, path, variables, **options)

    def _load(self, how, path, variables, as_of: Column | None = None, user: Column | None = None, **options) -> Report:
        jobs = stage(yaml_jobs(read_documents(self.spark, path)), "jobs")
        now = F.current_timestamp() if as_of is None else as_of
        who = F.current_user() if user is None else user
        load: Load = how(self.rows, jobs, now, who, variables, **options)
        # A rejected load is not written: the table stays as it is. Otherwise the merge is
        # computed once, when it is staged, and the table is written from there.
        staged = load if load.rejected else replace(load, merged=stage(load.merged, "merged"))
        if not load.rejected:
            overwrite(staged.table, self.name)
        failed = staged.problems.filter(F.col("resource_id").isNotNull())
        summary = load_summary(staged.accepted, failed, "resource_id", staged.merged)
        return Report(summary, staged.counts, staged.problems)

    def sync(
        self,
        folder: str,
        live: DataFrame,
        listing: DataFrame | None = None,
        watermark: Any = None,
        variables: Mapping[str, Any] | None = None,
        **options,
    ) -> Sync:
        """One poll: load the folder if its files changed, find changed jobs, and plan them.

        listing and watermark are those of the poll before, or None for the first one. The
        new watermark is the newest change among the rows read, so that a change that is
        made meanwhile is found by the next poll. A file whose load finds problems is not
        loaded again until it changes; its problems are in the report.
        """
        now = stage(list_files(self.spark, folder, YAML_GLOB), "listing")
        before = now.limit(0) if listing is None else listing
        files = stage(file_diff(before, now), "files")
        edited = not files.isEmpty()
        report = self.load_document(folder, variables, **options) if edited and not now.isEmpty() else None
        rows = stage(self.rows, "control")
        changes = changes_first(rows) if watermark is None else changes_since(rows, watermark)
        concerned = escalate(changes.select("resource_id"), rows.select("resource_id"), files)
        newest = rows.agg(F.max("updated_timestamp")).first()[0]
        plan = job_plan(only_loaded(rows, concerned, ["resource_id"]), self.spark.table(self.ids), live)
        return Sync(files, report, changes, plan, now, newest if newest is not None else watermark)

    def insert(self, rows: DataFrame) -> None:
        """Add rows; flags and times they lack take the table's defaults."""
        now = F.current_timestamp()
        defaults = {"disabled": F.lit(False), "created_timestamp": now, "updated_timestamp": now}
        insert_rows(self.spark.createDataFrame([], self.rows.schema), rows, defaults).write.insertInto(self.name)

    def update(self, condition: Column, assignments: Mapping[str, Column]) -> None:
        """Set columns of the selected rows and note the time."""
        stamped = {"updated_timestamp": F.current_timestamp(), **assignments}
        replace_own_source(update_where(self.rows, condition, stamped), self.name)

    def changes(self, watermark=None) -> DataFrame:
        return changes_first(self.rows) if watermark is None else changes_since(self.rows, watermark)

    def resources(self) -> DataFrame:
        return self.rows.select("resource_id").distinct()

    def tasks(self, job_name: str) -> DataFrame:
        return equals(self.rows, "job_name", job_name)

    def plan(self, live: DataFrame, only: DataFrame | None = None, **options) -> DataFrame:
        """What to do with every job, or with the jobs of one load."""
        rows = self.rows if only is None else self.rows.join(only.select("resource_id"), "resource_id", "left_semi")
        return job_plan(rows, self.spark.table(self.ids), live, **options)

    def task_plan(self, default_warehouse: Column | None = None) -> DataFrame:
        return task_plan(self.rows, default_warehouse)

    def store_ids(self, assigned: DataFrame, as_of: Column | None = None, user: Column | None = None) -> None:
        """Keep (resource_id, job_name, job_id) of many jobs."""
        audit = Audit(F.current_timestamp() if as_of is None else as_of, F.current_user() if user is None else user)
        replace_own_source(upsert_ids(self.spark.table(self.ids), assigned, audit), self.ids)
