"""Connected components of links held in DataFrames: alternating large-star and small-star, each round written to the shared folder.

Nothing is gathered on the driver but two counters a round. A hub's neighbours are never listed in one place: the smallest neighbour of a
node is an aggregate with partial sums, and it reaches the node's links by a join that may be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .shared import written

MAX_ROUNDS = 40


def _digest(edges: DataFrame) -> Row:
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long): component is the smallest node that is reachable. Links with a null or to itself don't count.

    Large-star links every larger neighbour of a node with its smallest neighbour (itself included); small-star every smaller one. Both keep what is
    connected; they end in stars around the smallest nodes.
    """
    edges = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    before = _digest(edges)
    for _ in range(MAX_ROUNDS):
        # large-star: of all neighbours and the node itself the smallest is m; larger neighbours link to m
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("node"), F.least("v", "m").alias("m"))
        # an edge (v > u): v is a larger neighbour of u, so v links to u's m
        large = edges.join(least, edges["u"] == least["node"]).select("v", F.col("m").alias("u")).where("v != u").distinct()
        # small-star: among smaller neighbours the smallest is m; the others and the node link to m
        small_min = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("node"), "m")
        linked = large.join(small_min, large["v"] == small_min["node"])
        small = linked.select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u").unionByName(small_min.select(F.col("node").alias("v"), F.col("m").alias("u")))
        after = written(small.distinct(), "links")
        state = _digest(after)
        edges = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("links did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
