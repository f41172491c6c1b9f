"""Connected components of a link table, by alternating large-star and small-star steps.

Each step replaces a node's links by links to the least node it knows of; nothing but three
numbers a round reaches the driver, and every round is written to the shared folder. The least
neighbour of each node is written before it is joined, so that a node with a third of all links
stands in a plain join, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, drop, saved


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def _both(edges: DataFrame) -> DataFrame:
    """Every link in both directions, as ``(u, v)``."""
    return edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    both = _both(edges).join(least, "u")
    return _directed(both.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").select(F.col("lo").alias("a"), F.col("m").alias("b"))
    return _directed(moved.unionByName(least.select(F.col("hi").alias("a"), F.col("m").alias("b"))))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))"), F.expr("bit_xor(xxhash64(lo, hi))")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` that has a link; ``root`` is the least
    node that can be reached."""
    edges = saved(_directed(edges))
    state = _state(edges)
    while True:
        least = saved(_both(edges).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        after = saved(_small_star(_large_star(edges, least)))
        drop(edges, least)
        edges, before, state = after, state, _state(after)
        if state == before:
            break
    out = checkpointed(edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()))
    drop(edges)
    return out
