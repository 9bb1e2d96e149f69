"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcat.plans.lineage import stored


def _directed(edges: DataFrame) -> DataFrame:
    return (
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: bigint); the label is the least node.

    Large-star and small-star steps in turn. Least neighbours are plain
    aggregates, joined back to the edges, so a node with very many edges is
    combined before the shuffle and split by the join. Each step is stored.
    """
    now = stored(_directed(edges))
    before = None
    while True:
        size = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if size == before or size.n == 0:
            break
        before = size
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(
            F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")
        )
        now = stored(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
