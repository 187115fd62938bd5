"""Staged tables: a plan is cut by writing it to the cluster's shared checkpoint folder.

A staged table survives the loss of executors, has a known size (so Spark can
choose its join strategy from it) and may replace a table its own plan reads.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; unset, a temporary one if all tasks run in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        _local_root[app] = tempfile.mkdtemp(prefix="millrace-")
    return _local_root[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch root."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write df once and return a scan of what was written; codec: Parquet's compression, unset the session's."""
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)
