"""Connected components of graphs too large for one task: alternating large and small stars.

In a large star every node hangs its larger neighbours on its smallest one; in a small star its smaller neighbours
and itself. Both keep components; the rounds end when every node points to its component's smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of the edges a, b; loops are ignored."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        now = stored(small.where("a <> b").distinct())
        # stars: each node points to one other, which points to none
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("out")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("out")))
        if ends.groupBy("node").agg(F.sum("out").alias("outs"), F.min("out").alias("low")).where("outs > 1 or outs = 1 and low = 0").isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
