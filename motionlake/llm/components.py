"""Connected components by alternating star contractions, all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, join_hot


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node has one edge downwards at most and none from above: then the ends are the components."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    per = ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return per.where("down > 1 or down + up > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id in ``edges`` (u, v); component is the smallest id reachable.

    Large-star links every larger neighbour of a node to the least node around it, small-star does
    so for the smaller ones; the depth of the trees halves, so rounds grow with the logarithm of the
    longest path.  The minimum per node is pre-aggregated before its shuffle, and adaptive execution
    may split the join where one node has very many neighbours.  It ends once all trees are stars.
    Edges from a node to itself and null ends are ignored; without edges the result is empty.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges)
    while not _is_star_forest(edges):
        around = _both_ways(edges)
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        large = join_hot(around, least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u <> v")  # a row for each edge at most
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, edges = edges, cut(small.where("u <> v").distinct())
        drop(before)
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
