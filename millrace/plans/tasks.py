"""Parameterised tasks: inline SQL, SQL files and table ingestion."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators.transform import equals, full_name as spaced_name, with_lineage
from millrace.operators.validate import load_status
from millrace.sinks.tables import write_table, write_verified
from millrace.sources.tables import full_name, scan_or_sample

# The parameters every ingestion needs, and the mode it defaults to.
INGESTION_PARAMETERS = ("catalog", "schema", "source_table", "target_table")
DEFAULT_WRITE_MODE = "overwrite"

# Strings, quoted names and comments are skipped over; only the bare `;` ends a statement.
_SQL_PIECES = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;", re.S)


def run_query(spark: SparkSession, sql: str, parameters: Mapping[str, Any] | None = None) -> DataFrame:
    """One statement with :name markers; values are bound as strings and cast by the query."""
    return spark.sql(sql, args={name: str(value) for name, value in (parameters or {}).items()})


def statements(script: str) -> list[str]:
    """The statements of a script, without the ones that hold nothing but comments."""
    ends = [m.start() for m in _SQL_PIECES.finditer(script) if m.group() == ";"]
    starts = [0, *[end + 1 for end in ends]]
    pieces = [script[a:b].strip() for a, b in zip(starts, [*ends, len(script)])]
    bare = lambda text: re.sub(r"--[^\n]*|/\*.*?\*/", "", text, flags=re.S).strip()
    return [piece for piece in pieces if bare(piece)]


def run_script(spark: SparkSession, script: str, parameters: Mapping[str, Any] | None = None) -> DataFrame:
    """Every statement of a script in order; the result of the last one."""
    result = None
    for statement in statements(script):
        result = run_query(spark, statement, _used(statement, parameters or {}))
    if result is None:
        raise ValueError("the script holds no statement")
    return result


def _used(statement: str, parameters: Mapping[str, Any]) -> dict[str, Any]:
    return {name: value for name, value in parameters.items() if re.search(rf":{re.escape(name)}\b", statement)}


def run_sql_file(spark: SparkSession, path: str, parameters: Mapping[str, Any] | None = None) -> DataFrame:
    """As run_script, for a file on any file system Spark reads."""
    script = spark.read.text(path, wholetext=True).first()["value"]
    return run_script(spark, script, parameters)


@dataclass(frozen=True)
class Ingestion:
    """A checked set of ingestion parameters."""

    task_key: str
    catalog: str
    schema: str
    source_table: str
    target_table: str
    write_mode: str = DEFAULT_WRITE_MODE

    @classmethod
    def of(cls, task_key: str, parameters: Mapping[str, str]) -> Ingestion:
        missing = [name for name in INGESTION_PARAMETERS if not parameters.get(name)]
        if not task_key:
            missing.insert(0, "task_key")
        if missing:
            raise ValueError(f"missing ingestion parameters: {', '.join(missing)}")
        return cls(
            task_key,
            *[parameters[name] for name in INGESTION_PARAMETERS],
            parameters.get("write_mode") or DEFAULT_WRITE_MODE,
        )

    @property
    def source(self) -> str:
        return full_name(self.catalog, self.schema, self.source_table)

    @property
    def target(self) -> str:
        return full_name(self.catalog, self.schema, self.target_table)


def ingest_rows(
    source: DataFrame,
    task_key: str,
    as_of: Column,
    keep: tuple[str, Any] = ("status", "active"),
    name_parts: tuple[str, ...] = ("first_name", "last_name"),
) -> DataFrame:
    """Lineage columns, the full name, and only the rows to keep."""
    kept = equals(source, *keep)
    return with_lineage(kept, task_key, as_of).withColumn("full_name", spaced_name(*map(F.col, name_parts)))


def ingest(spark: SparkSession, task: Ingestion, sample: DataFrame, as_of: Column, **options) -> dict[str, int]:
    """Read the source (or make it from the sample), transform, write, and report the counts."""
    source = scan_or_sample(spark, task.source, sample)
    return write_verified(
        source,
        lambda df: ingest_rows(df, task.task_key, as_of, **options),
        lambda df: write_table(df, task.target, task.write_mode),
        lambda: spark.table(task.target).count(),
        task.write_mode,
        spark.catalog.tableExists(task.target),
    )


def ingest_then_validate(
    spark: SparkSession, task: Ingestion, sample: DataFrame, as_of: Column, **options
) -> DataFrame:
    """Ingest, then one row that says whether every kept row arrived."""
    counts = ingest(spark, task, sample, as_of, **options)
    frame = spark.createDataFrame([counts], "rows_read bigint, rows_kept bigint, rows_before bigint, rows_in_target bigint")
    return load_status(frame).withColumn("validation_timestamp", as_of)
