"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v): every node's neighbours move to the least of them."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = around.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (u, v: long), root being the least node that it reaches.

    A star step only groups and joins by node: minima are combined before the shuffle, and adaptive
    execution splits the join of a node with very many neighbours. Each round is written as a table, so
    a lost executor repeats one round at most.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    digest = None
    for _ in range(rounds):
        step = materialize(_star(now, large=True), "large")
        after = materialize(_star(step, large=False), "small")
        discard(now)
        discard(step)
        now = after
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(found) == digest:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        digest = tuple(found)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
