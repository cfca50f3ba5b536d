"""Connected components of an edge table by alternating large-star and small-star joins.

The union-find forest lives in Spark tables only.  Each round joins nodes with
the minimum of their neighbourhood, so a node with very many neighbours is a
skewed join, which adaptive execution splits, and never one task's list.  Whether
a round changed anything is observed while its table is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .storage import drop, if_small, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges ``u > v``; the result again has ``u > v``."""
    near = edges
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("u", "m"))
        moved = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where("u > v").distinct()
    both = near.join(least, "u")
    moved = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    seen = Observation()
    table = materialize(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.max("v").alias("v")), "edges")
    return table, seen.get


def connected_components(edges: DataFrame) -> DataFrame:
    """A table ``node, component`` (the least node reachable) of every node of ``edges(a, b)``."""
    state, before = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while before.get("n"):
        following, now = _written(_star(_star(state, True), False))
        drop(state)
        state = following
        if now == before:
            break
        before = now
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = materialize(state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    drop(state)
    return out


def merge_components(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups(node, component)`` after ``links(la, lb)`` between components.

    A node that is in no group yet is its own component, so only what the links
    name takes part in the search, however large the groups are.
    """
    over = connected_components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    old = over.select(F.col("node").alias("old"), F.col("component").alias("new"))
    known = groups.join(if_small(old), F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    fresh = over.join(groups.select("node"), "node", "left_anti")
    out = materialize(known.unionByName(fresh.select("node", "component")), "groups")
    drop(groups, over)
    return out
