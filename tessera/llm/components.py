"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node that it reaches.

    Each round hangs neighbours under the smallest node in sight, first those above a node, then
    those below, so the number of rounds grows with the logarithm of a component's size. Rounds are
    written to the shared folder; the driver sees one bit a round. A node with very many
    neighbours is a skewed key of plain joins and of aggregations that combine before they shuffle."""
    with scratch(edges.sparkSession):
        now, k = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), 0
        while True:
            ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = ways.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            under = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(under, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))).filter("u <> v").distinct()
            now, k = written(small, f"{label}-{k}"), k + 1
            # done when all hang under roots: no node has two above it, no root one
            ends = now.select(F.col("u").alias("x"), F.lit(2).alias("w")).unionByName(now.select(F.col("v").alias("x"), F.lit(1).alias("w")).distinct())
            if ends.groupBy("x").agg(F.sum("w").alias("w")).filter("w > 2").isEmpty():
                break
        stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return written(stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), label, keep=True)
