"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logwarden.session import discard, materialize


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour instead."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them. Edges point downwards."""
    least = _least_neighbour(edges)
    tied = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): each node that isn't the least of its component, with the least.

    Takes undirected edges (u, v), in any direction and number; loops are dropped. No node's
    neighbours are ever gathered in a row: both steps are a minimum by node and a join, which
    can be split where a node has many. The table shrinks to stars in a logarithmic number of
    rounds, when no least node is tied to another; each round is written, so a lost executor
    costs one round.
    """
    now, old = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), None
    while True:
        now = materialize(_small_star(_large_star(now)), "stars")
        if old is not None:
            discard(old)
        old = now
        if now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            return now
