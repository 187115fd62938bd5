"""Configuration documents: one row per document in, one row per job out."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

try:
    import yaml
except ImportError:  # JSON documents need no parser
    yaml = None

# The file name endings of documents.
YAML_GLOB = "*.{yaml,yml}"
JSON_GLOB = "*.json"

REPEATED, EMPTY = "repeated_resource_id", "empty_document"
_JOB_SCHEMA = "path string, resource_id string, job string, reason string"


def read_documents(spark: SparkSession, folder: str, glob: str = YAML_GLOB) -> DataFrame:
    """(path, content) for every document below folder, sub-folders included.

    Spark's sources read no file of no bytes: such files are known from the scan's own
    listing, which the driver holds anyway, and have no content.
    """
    scan = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    texts = scan.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    listed = spark.createDataFrame([(_as_scanned(path),) for path in scan.inputFiles()], "path string")
    empty = listed.join(texts.select("path"), "path", "left_anti")
    return texts.unionByName(empty.withColumn("content", F.lit(None).cast("string")))


def _as_scanned(uri: str) -> str:
    """A local file's URI as rows name it, with one slash."""
    return "file:/" + uri.removeprefix("file:///") if uri.startswith("file:///") else uri


def _yaml_jobs(path: str, content: str) -> Iterator[tuple]:
    """A row for each entry of the jobs mapping; a parser's dict would keep the last of equal keys alone."""
    if content is None:
        yield path, None, None, EMPTY
        return
    try:
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)(content)
        try:
            root = loader.get_single_node()
            sections = _entries(loader, root) if isinstance(root, yaml.MappingNode) else []
            jobs = next((node for key, node in reversed(sections) if key == "jobs"), None)
            mapping = isinstance(jobs, yaml.MappingNode)
            found = [(str(k), _json_text(loader.construct_object(v, deep=True))) for k, v in _entries(loader, jobs)] if mapping else []
            empty = jobs is None or not mapping and loader.construct_object(jobs, deep=True) is None
        finally:
            loader.dispose()
    except (yaml.YAMLError, ValueError, TypeError, RecursionError):
        # What no parser accepts and what no JSON can say, NaN or an impossible date for instance.
        yield path, None, None, "invalid_document"
        return
    if empty:
        yield path, None, None, "no_jobs_key"
    elif not mapping:
        yield path, None, None, "jobs_not_a_mapping"
    else:
        times = Counter(resource_id for resource_id, _ in found)
        for resource_id, text in found:
            yield path, resource_id, text, REPEATED if times[resource_id] > 1 else None


def _entries(loader, mapping) -> list[tuple]:
    """(key, node) of all entries of a mapping, merged ones included, equal keys as often as they stand there."""
    loader.flatten_mapping(mapping)
    return [(loader.construct_object(key, deep=True), node) for key, node in mapping.value]


def _json_text(value) -> str:
    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, (list, tuple, set)) else x

    return json.dumps(plain(value), ensure_ascii=False, default=str, allow_nan=False)


def yaml_jobs(documents: DataFrame) -> DataFrame:
    """(path, resource_id, job, reason): each document is parsed where it lies, on an executor."""
    if yaml is None:
        raise ImportError("YAML documents need the yaml module; use json_jobs for JSON documents")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "resource_id", "job", "reason"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(list(_yaml_jobs(path, content)), columns=columns, dtype=object)

    return documents.select("path", "content").mapInPandas(parse, _JOB_SCHEMA)


def json_jobs(documents: DataFrame) -> DataFrame:
    """As yaml_jobs for JSON documents, on built-in functions alone.

    The parser of variants takes no document that names a key twice, so those it refuses
    are read once more as plain maps, which keep every entry.
    """
    document = F.try_parse_json("content")
    jobs = F.try_variant_get("document", "$.jobs", "variant")
    refused = F.when(F.col("document").isNull(), F.from_json("content", "struct<jobs:map<string,string>>")["jobs"])
    named = F.map_keys("_refused")
    parsed = (
        documents.select("path", "content", document.alias("document"))
        .withColumn("_refused", refused)
        .select(
            "path",
            F.when(F.size(F.array_distinct(named)) < F.size(named), F.col("_refused")).alias("_entries"),
            F.try_variant_get("document", "$.jobs", "map<string,variant>").alias("jobs"),
            F.when(F.col("content").isNull(), EMPTY)
            .when(F.col("document").isNull(), "invalid_document")
            .when(jobs.isNull() | F.is_variant_null(jobs), "no_jobs_key")
            .when(~F.schema_of_variant(jobs).startswith("OBJECT"), "jobs_not_a_mapping")
            .alias("reason"),
        )
    )
    texts = F.coalesce("_entries", F.transform_values("jobs", lambda _, v: F.to_json(v)))
    keys = F.map_keys("_entries")
    exploded = parsed.select(
        "path", "_entries", F.when(F.col("_entries").isNull(), F.col("reason")).alias("reason"),
        F.sort_array(keys).alias("_keys"), F.explode_outer(texts).alias("resource_id", "job"),
    )
    # In sorted keys, equal ones lie side by side.
    at = F.array_position("_keys", F.col("resource_id"))
    twice = F.try_element_at("_keys", (at + 1).cast("int")) == F.col("resource_id")
    reason = F.when(F.col("_entries").isNotNull() & twice, REPEATED).otherwise(F.col("reason"))
    return exploded.select("path", "resource_id", "job", reason.alias("reason")).filter(
        F.col("resource_id").isNotNull() | F.col("reason").isNotNull()
    )


def has_document_name(path: Column) -> Column:
    """True for paths that end like a YAML document."""
    return path.rlike(r"\.ya?ml$")


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)
