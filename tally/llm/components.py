"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node is tied to one other at most, and that one to none: then that one is its component. Edges have a > b."""
    role = lambda x, ties: F.struct(F.col(x).alias("node"), F.lit(ties).alias("ties"))
    roles = edges.select(F.explode(F.array(role("a", 1), role("b", 0))).alias("x")).select("x.*")
    of = roles.groupBy("node").agg(F.sum("ties").alias("ties"), F.min("ties").alias("least"))
    return of.agg(F.count_if(F.expr("ties > 1 or (ties = 1 and least = 0)"))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b: long); component: the smallest node reached.

    Each step's links are a written table, so the plan stays short; only one
    count comes to the driver. A star forest is the fixed point, and ends it.
    """
    directed = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = written(links.select(*directed).filter("a <> b").distinct(), "links")
    while not _stars(edges):
        edges = written(_small_star(_large_star(edges).select(*directed)), "links")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
