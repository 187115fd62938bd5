"""Tables bucketed and sorted by their keys, merged bucket by bucket."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.sources.staging import scratch_path


def write_bucketed(rows: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None, dealt: bool = False) -> None:
    """Write rows as a new table of `buckets` files, each sorted by the keys.

    dealt: rows are dealt over tasks by a join on the keys of such a table already.
    """
    path = path or scratch_path(rows.sparkSession, name)
    rows = rows if dealt else rows.repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("error").saveAsTable(name)


def replace_bucketed(
    spark: SparkSession, name: str, merged: Callable[[DataFrame], DataFrame], keys: Sequence[str], buckets: int
) -> None:
    """Replace a bucketed table by what merged() makes of it.

    The target is read, joined and written bucket by bucket and never shuffled; the source
    is dealt over as many buckets. Keys of the target are complete: rows without one would
    all share a bucket. The new files are written beside the old ones, then the names are
    exchanged; a run that fails before leaves the table as it was. Files of the old table
    are left for the cluster's own cleaning.
    """
    target = spark.table(name)
    if target.filter(" OR ".join(f"`{k}` IS NULL" for k in keys)).select(F.lit(1)).limit(1).count():
        raise ValueError(f"{name} holds rows without {', '.join(keys)}")
    spark.sql(f"DROP TABLE IF EXISTS {name}_next")
    write_bucketed(merged(target), f"{name}_next", keys, buckets, dealt=True)
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {name}_next RENAME TO {name}")
