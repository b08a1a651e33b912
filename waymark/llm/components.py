"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import remove, spread_join, stored


def components(edges: DataFrame, folder: str, most: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the least node that links reach.

    Each step is a grouped minimum and a join back (spread_join, so a node with many links doesn't fall to one task); it is
    written to the shared folder, which cuts the lineage. Steps end when the sum over the edge table no longer changes. Needs
    O(log n) steps.
    """
    spark = edges.sparkSession
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{folder}/edges")
    size, before, path = now.count(), None, f"{folder}/edges"
    for k in range(most):
        # large star: larger neighbours go to the least neighbour; small star: it and smaller neighbours do.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = spread_join(both, least, "u", "n", 2 * size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), f"{folder}/large-{k}")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = spread_join(large, least, "u", "n", 2 * size).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where("u <> v").distinct()
        old, path = path, f"{folder}/step-{k}"
        now = stored(small, path)
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        size = after[0]
        remove(spark, old)
        remove(spark, f"{folder}/large-{k}")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components didn't settle in {most} steps")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
