"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a partial aggregate (the least neighbour of a node) and a join back, both
on plain keys, so a node with very many neighbours is pre-aggregated in the first and
split by AQE in the second.  Every step's edges are written to the shared
folder, and those of the step before removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.llm.common import saved
from caliper.operators.prefix import discard


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large star) or the smaller neighbours of each node to its least one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else edges.where("u > v").unionByName(
        edges.where("u < v").select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    linked = near.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v): the least node
    that can be reached.  Nodes without edges are not listed."""
    edges = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        before, edges = edges, saved(_star(_star(edges, True), False))
        discard(before)
        last, state = state, _state(edges)
        if state == last:
            break
    ends = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
