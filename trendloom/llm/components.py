"""Connected components of a graph by alternating large stars and small stars.

No list of neighbours is ever gathered: each step is a minimum per node, combined
on the map side, joined back to the edges.  Steps are written, so a lost executor
costs a part of one step; their number grows with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) of every node of ``edges`` (a, b)."""
    a, b = F.greatest("a", "b"), F.least("a", "b")
    stars = edges.filter(F.col("a") != F.col("b")).select(a.alias("a"), b.alias("b")).distinct()
    stars, before = materialize(stars, "stars"), None
    while (state := _state(stars)) != before:
        before = state
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(materialize(least, "large-star"), "a").filter(F.col("b") > F.col("a"))
        large = materialize(large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "small-star")
        moved = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = materialize(moved.unionByName(least.withColumnRenamed("m", "b")).distinct(), "stars")
    roots = stars.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(stars: DataFrame) -> tuple:
    """What changes as long as the edges do."""
    digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(stars.agg(F.count("*"), digest).first())
