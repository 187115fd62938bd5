"""Session defaults the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Templates such as ${var.env} live in columns; SQL text must keep them as they are.
    "spark.sql.variable.substitute": "false",
}

# For large clusters: many initial shuffle partitions, which AQE then joins to even sizes.
CLUSTER_CONF = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def build_session(app: str = "millrace", master: str | None = None, cluster: bool = False, **conf: str) -> SparkSession:
    """A session with SESSION_CONF; a cluster sets its own master and checkpoint folder."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SESSION_CONF, **(CLUSTER_CONF if cluster else {}), **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
