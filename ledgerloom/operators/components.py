"""Connected components by alternating stars; no task and no driver holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b: long): (node, root) with root the smallest node that node is connected to, itself not listed.

    A large star hands each node's larger neighbours to its smallest one, a small star the
    smaller ones; when nothing moves, each node's only smaller neighbour is its root. Self-loops and nulls are left out."""
    star = scratch.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    before = _state(star)
    while before[0]:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = scratch.save(large, "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        small = scratch.save(small, "small")
        scratch.drop(star, large)
        star, after = small, _state(small)
        if after == before:
            break
        before = after
    return star.select(F.col("a").alias("node"), F.col("b").alias("root"))
