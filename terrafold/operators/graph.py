"""Connected components of a graph that is spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.session import large, written


def connected(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) of every node of edges (a, b); nodes may be of any type with an order.

    Stars are joined in rounds: every node's larger neighbours go to its smallest one, then every node and its smaller
    neighbours go to the smallest of them. The rounds grow with the logarithm of the longest chain; a round is a few
    groupings by node with partial minima, so a node with very many edges is no task's own.
    """
    stars = written(edges.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("top")).filter("child != top").distinct())
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("top").alias("child"), F.col("child").alias("top")))
        least = both.groupBy("child").agg(F.least(F.min("top"), F.col("child")).alias("m"))
        larger = both.filter("top > child").join(large(least), "child").select(F.col("top").alias("child"), F.col("m").alias("top")).distinct()
        least = larger.groupBy("child").agg(F.min("top").alias("m"))
        moved = larger.join(large(least), "child").filter("top != m").select(F.col("top").alias("child"), F.col("m").alias("top"))
        stars = written(moved.unionByName(least.select("child", F.col("m").alias("top"))).distinct())
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("child", "top").cast("decimal(38,0)"))).first()
        if now == before:
            roots = stars.select(F.col("top").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return stars.select(F.col("child").alias("node"), F.col("top").alias("root")).unionByName(roots)
        before = now
