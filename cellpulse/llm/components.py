"""Connected components by contraction, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.plans.storage import durable


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(u, v)``; the root is the smallest node of its component.

    Each round every node points to its smallest neighbour or itself, the pointers are doubled once, and the edges
    are rewritten between the nodes pointed to. Loops and repeated edges vanish, so the edge table shrinks until it is empty.
    Each round's pointers and edges are written, so a lost executor repeats one round at most. The answer
    follows the pointers of all rounds, last round first.
    """
    left = durable(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        nearest = _both_ways(left).groupBy("u").agg(F.min("v").alias("v"))
        step = durable(nearest.select(F.col("u").alias("node"), F.least("u", "v").alias("to")), "pointers")
        again = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        pointers = durable(step.join(again, "to").select("node", F.col("further").alias("to")), "pointers")
        rounds.append(pointers)
        ends = [pointers.select(F.col("node").alias(c), F.col("to").alias(f"_{c}")) for c in ("u", "v")]
        moved = left.join(ends[0], "u").join(ends[1], "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
        left = durable(moved.filter("u <> v").distinct(), "edges")
    if not rounds:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    result = rounds.pop().withColumnRenamed("to", "root")
    while rounds:
        known = result.select(F.col("node").alias("to"), "root")
        joined = rounds.pop().join(known, "to", "left")
        result = joined.select("node", F.coalesce("root", "to").alias("root"))
    return result
