"""Connected components of a link table, by alternating large-star and small-star.

Both steps only take minima over a node's neighbours and re-point its links, so
no task ever holds all links of a node; the driver sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, fetch, shuffled


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) with v < u. Re-points neighbours to the smallest one."""
    if large:  # neighbours above the node go to the smallest neighbour
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = Staged(least, "links-least").df  # a table of its own, so that the links of a hub can be split in the join
    joined = both.join(shuffled(least), "u")
    if large:
        return joined.where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u != v").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, component`` (the smallest node) of every node that has a link.
    Null ends and self-links are ignored; an empty table gives an empty one."""
    links = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"), F.col(u).isNotNull().alias("a"), F.col(v).isNotNull().alias("b"))
    links = links.where("a and b and u != v").select("u", "v").distinct()
    table, before = Staged(links, "links"), None
    while True:
        now = fetch(table.df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h"))).iloc[0].tolist()
        if now == before:
            break
        before, old = now, table
        large = Staged(_star(table.df, True), "links-large")
        table = Staged(_star(large.df, False), "links")
        old.drop()
        large.drop()
    return table.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(table.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
