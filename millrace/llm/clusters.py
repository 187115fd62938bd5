"""Verification inside clusters of candidates, in tasks of bounded size.

Candidates that share a bucket are linked to the bucket's least member; components of those
links are clusters, and every pair of candidates lies in one cluster. A cluster is dealt in
chunks, and each pair of chunks is one task's work, so a huge cluster is many tasks and no
pair is lost. Pairs are compared where they meet and never become rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.graphs import components

# A chunk's members and the sum of their weights.
MEMBERS, WEIGHT = 2048, 1_500_000


def clusters(buckets: DataFrame) -> DataFrame:
    """(node, class) from (bucket, node): nodes that share a bucket, directly or through others."""
    least = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("_last"))
    shared = least.filter(F.col("a") != F.col("_last")).select("bucket", "a")
    return components(buckets.join(shared, "bucket").select("a", F.col("node").alias("b")))


def verified(
    members: DataFrame, compare: Callable[[pa.Table], pa.Table], schema: str, most: int = MEMBERS, weight: int = WEIGHT
) -> DataFrame:
    """compare's rows for every pair of chunks of every cluster.

    members: (class, node, weight, ...), a row for each node. compare gets the rows of one
    or two chunks, with their chunk in the column chunk, and looks at the pairs within its
    chunk or, if there are two, across them.
    """
    sizes = members.groupBy("class").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    chunks = F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("w") / weight)).cast("int")
    dealt = members.join(sizes.select("class", chunks.alias("chunks")), "class").withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    )
    others = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    paired = dealt.withColumn("other", others)
    work = F.struct("class", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    return paired.withColumn("work", work).drop("class", "chunks", "other").groupBy("work").applyInArrow(compare, schema)


class Sets:
    """Disjoint sets of positions; the root is the least."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
