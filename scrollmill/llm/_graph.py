"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a minimum by key (combined before the shuffle) and a join; the number of steps grows
with the logarithm of the longest chain. Nothing is gathered on the driver but one number a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v) with u > v. Large: larger neighbours of a node move to its least; small: smaller ones do."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no other edge's smaller end."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").limit(1).count()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has a link to another; component is the least node reachable.

    Null ends, links of a node to itself, repeated links and either direction are allowed; no links give no rows.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = settle(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    while not _stars(edges):
        before, edges = edges, settle(_star(_star(edges, True), False), "edges")
        discard(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
