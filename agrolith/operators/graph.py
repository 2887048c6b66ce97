"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.operators.scratch import forget, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours hang on the least node near it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours hang on the least of them. Edges point from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    down = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("a", F.col("m").alias("b"))).distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node with an edge, other than components' least nodes themselves.

    edges: (a, b), any direction, repeated edges and loops allowed. The result is a written table. Each turn is written too, so
    that lost executors cost one turn at most; hot nodes go through partial aggregates and joins that can be split.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        then, before = now, state
        now = written(_small_star(_large_star(then)))
        forget(then)
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node reaches, itself included. nodes: (node); edges as above."""
    return nodes.join(star_components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
