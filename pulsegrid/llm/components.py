"""Connected components by alternating large-star and small-star steps, all joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(edges: DataFrame) -> DataFrame:
    return stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is hung under the least node of u's neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), "u").withColumn("m", F.least("u", "m"))
    return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u itself, is hung under the least of them."""
    joined = edges.join(_least(edges), "u")
    moved = joined.where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(joined.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node but a component's least one, and that least node. Edges are pairs u > v of bigint.

    Empty edges give an empty result. Each step writes its edges, so the plan stays short and a lost
    executor costs one step; the number of steps grows with the logarithm of the diameter.
    """
    edges = stored(edges.select("u", "v").where(F.col("u") > F.col("v")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = stored(_small_star(stored(_large_star(edges), "large")), "small")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges
