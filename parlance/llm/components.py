"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; nothing about the graph comes to the driver but a count and
a checksum. The number of rounds grows with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of a node is tied to the least of them all; small: the smaller ones and the node itself."""
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    tied = both.join(least, "a")
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b): the smallest node it reaches.

    Loops and repeated edges do no harm; rows with a null are dropped. No edges: an empty table.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while _unsettled(now):
        last = now
        now = staged(_star(_star(now, True), False), "edges")
        unstage(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two roots, or is a root and has one itself; else the edges are stars around the smallest nodes."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("has"), F.lit(0).alias("is"))
    ends = ends.unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("has"), F.lit(1).alias("is")))
    return not ends.groupBy("n").agg(F.sum("has").alias("has"), F.max("is").alias("is")).where("has > 1 or has > 0 and is > 0").isEmpty()


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` after more ``links`` (a, b, with their components ca and cb): only the components that meet are worked on."""
    joint = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    joint = staged(joint.select(F.col("node").alias("component"), F.col("component").alias("into")), "joint")
    old = comp.join(joint, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    # single nodes that a link has reached for the first time
    new = joint.select(F.col("component").alias("node"), F.col("into").alias("component")).join(comp.select("node"), "node", "left_anti")
    return old.unionByName(new)
