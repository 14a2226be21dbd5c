"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import cut_lineage


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node each linked node can reach.

    Large-star and small-star steps by turns until all that is left are stars: a few rounds for any shape,
    each two joins on the node; only whether a node is no star's reaches the driver.  Nodes without links
    are absent.
    """
    edges = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .filter("u > v").distinct())
    edges = cut_lineage(edges)
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = cut_lineage(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(parent, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        edges = cut_lineage(small.unionByName(parent.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
