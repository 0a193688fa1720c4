"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialise


#: Edges that a task takes at least, unless there are fewer than LEAST such tasks: small rounds needn't be dealt out over all partitions.
EDGES, LEAST = 1 << 15, 4


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (a, b), root the least node of its component.

    Each round points nodes to smaller neighbours: the large step links every larger neighbour of a node to the least one around it, the small
    step every smaller one. Rounds end when the edges are stars: each larger node has one edge, and none is the least of another. Only per-node minima
    are aggregated, so a node of millions of neighbours is combined before the shuffle; every round's edges are written to the shared folder, in as
    many parts as their number asks for. Joins on a hub's neighbours are left to Spark's adaptive split of skewed joins. Rounds grow with the logarithm
    of the longest chain; if most_rounds don't do, that is an error, never a partial result.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    parts = max(LEAST, e.count() // EDGES)
    for _ in range(most_rounds):
        if _stars(e, parts):
            break
        # large star: both directions; each neighbour v > u goes to the least of u's neighbourhood (u included)
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
        least = materialise(least.coalesce(parts))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialise(large.coalesce(parts))
        # small star: smaller neighbours and u itself go to the least of them
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u").coalesce(parts))
        small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        new = materialise(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct().coalesce(parts))
        drop(e, least, large, low)
        e = new
    else:
        raise RuntimeError(f"components not found in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(e: DataFrame, parts: int) -> bool:
    """Whether each a of the edges has one b and is the b of none."""
    ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("x"), F.lit(0).alias("up")))
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n")).coalesce(parts)
    return per.filter("up > 1 or up > 0 and n > up").isEmpty()
