"""Connected components of a table of links, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import drop_table, materialize


def _open(links: DataFrame) -> bool:
    """Whether some node still has two targets, or a target and a node that points to it; else all links form stars."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (u, v); the component is its smallest node.

    Links are turned into stars in turns: each node points its larger neighbours to its smallest one, then itself and its smaller
    neighbours. Both steps are a minimum by node joined back to the links, so a node with very many neighbours is a skewed join
    and never a group in memory. Rounds grow with the logarithm of the longest path and end once all links form stars. Null ends
    are ignored; no links, no rows.
    """
    now = materialize(links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while _open(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        stars = materialize(large, "large-star")
        drop_table(now)
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        small = stars.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star")
        drop_table(stars)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
