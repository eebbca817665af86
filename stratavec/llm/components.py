"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def connected_components(links: DataFrame) -> DataFrame:
    """node, root: for every node of the links (a, b), the smallest node of its component. Nodes may be of any type that
    has an order.

    Each round is two grouped minimums, which combine before the shuffle, and two joins that AQE may split at a hub; it
    ends when every node hangs on one other at most, which hangs on none. Rounds are cut by written tables; the driver sees one row per
    round. Null ends and links of a node to itself are left out."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "links")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_m, "u")
        last = edges
        edges = saved(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_m.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        discard(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    hanging = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u")
    several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    return hanging.unionByName(several).isEmpty()
