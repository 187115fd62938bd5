"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from millrace.sources.staging import stage


def components(links: DataFrame) -> DataFrame:
    """(node, class) for every node of links (a, b), class being its component's least node.

    Each round points every node's larger neighbours, then its smaller ones, at the least
    node it knows; both keep the components and shrink them to stars in about the logarithm
    of their size rounds. A round is written to the checkpoint folder, so lost executors
    cost no more than that round. NULL ends are ignored. No row is ever gathered by its
    component: the least neighbour is a partial aggregate, the rest a join.
    """
    pairs = links.select("a", "b").filter(F.col("a") != F.col("b"))
    edges = stage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
            .join(least.withColumn("m", F.least("m", "u")), "u")
            .select(F.col("w").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = stage(large, "large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.select(F.col("u"), F.col("m").alias("v")).unionByName(
            joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        changed = Observation()
        marks = edges.withColumn("_old", F.lit(1)).unionByName(small.distinct().withColumn("_old", F.lit(0)))
        merged = marks.groupBy("u", "v").agg(F.max("_old").alias("old"), F.min("_old").alias("_new"))
        merged = merged.observe(changed, F.count_if(F.col("old") + F.col("_new") != 1).alias("n"))
        rounds = stage(merged, "stars")
        edges = rounds.filter(F.col("_new") == 0).select("u", "v")
        if not changed.get["n"]:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("class"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct())
