"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them; u > v in every link."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: u, v.  Returns node and the least node that it can reach, for all nodes with a link; a saved table."""
    edges = saved(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        after = saved(_small_star(_large_star(edges)))
        # Both tables hold a link once, so they are equal if they have as many links and none is new.
        same = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        forget(edges)
        edges = after
        if same:
            break
    found = saved(edges.select(F.col("u").alias("node"), F.col("v").alias("least")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct()))
    forget(edges)
    return found
