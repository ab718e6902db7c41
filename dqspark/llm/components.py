"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dqspark.session import materialize


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum of a stored edge table."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the least node reachable.

    Each round links every neighbour above a node, then every neighbour below it, to the least
    node of its neighbourhood. Minima are combined before the shuffle, neighbour lists are never
    gathered, and each round is a written table, so lineage stays short. An empty edge table
    gives an empty result; loops and repeated edges do no harm.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"),
                                        F.least("a", "b").alias("lo")).distinct()
    now = materialize(now, "edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.filter("v > u").join(least, "u").select(
            F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        below = up.groupBy("hi").agg(F.min("lo").alias("m"))
        down = up.join(below, "hi").select(
            F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")),
                              F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        now = materialize(down.select("e.*").filter("hi <> lo").distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
