"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step sends a row per link and keeps only minima per node, with partial aggregation; no neighbour list is collected
and nothing but one row count reaches the driver. Each step is written to the shared folder.

Defined results: links with a null end and links of a node to itself say nothing; repeated links and both directions of one
count once; nodes may be of any type that has an order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import settle


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, label): label is the smallest node reachable; nodes without links to others are absent."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = settle(links.where("a <> b and a is not null and b is not null").select(high.alias("u"), low.alias("v")).distinct(), "links")
    while not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        large = settle(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = settle(small, "links")
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(heads)
