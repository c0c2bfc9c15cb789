"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def _min_of(edges: DataFrame) -> DataFrame:
    """Smallest of each u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and root, the smallest node that links reach, of every node that has an edge (a, b).

    Every step rewires edges to smaller nodes and never splits a component; it ends when each node has one edge, to a
    node that has none to a smaller one. Minima are combined before they are shuffled; the driver sees one row for
    each step.
    """
    state = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    turn = 0
    while not _is_star(state):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_min_of(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        own = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = own.join(own.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        turn += 1
        state = scratch.keep(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _is_star(state: DataFrame) -> bool:
    ends = state.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(state.select(F.col("v"), F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()
