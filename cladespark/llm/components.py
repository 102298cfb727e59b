"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.llm import staging

MOST_ROUNDS = 40


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v), u > v. Each node's neighbours (all or the smaller ones) are tied to the smallest of them and it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    near = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a, b): root is the smallest node of its component.

    A round is two stars, staged; the edges become one star for each
    component, and two equal rounds end it. No task holds a component: minima
    are pre-aggregated, and joins on a node that has many edges can be split.
    """
    now = staging.stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = mark(now)
    for _ in range(MOST_ROUNDS if before[0] else 0):
        now = staging.stage(_star(_star(now, large=True), large=False), "stars")
        if (after := mark(now)) == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
