"""Distributed connected components by alternating large-star and small-star steps.

Every step is a partial minimum per node and an equi join with these minima. They are written first, so that the join is a
checked broadcast or has a shuffle of its own on both sides, which adaptive execution can split at a hub; no group is ever
gathered in one task. Steps never add edges, so where one count shows that the minima of all rounds are few enough to be
broadcast, a round is a single query and writes its edges alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.runtime import BROADCAST_ROWS, broadcast_if_small, discard, materialize

#: Steps to smaller neighbours that an edge of a small graph climbs in a round.
JUMPS = 3


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one node at most, and none to a node that points on: each component is a star."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    roles = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return roles.where("out > 1 or (out = 1 and into = 1)").isEmpty()


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges from larger to smaller nodes.

    The first links each node's larger neighbours to the smallest of its closed neighbourhood, the second each node and its
    smaller neighbours to the smallest of them.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    larger = both.where("v > u").join(broadcast_if_small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    larger = materialize(larger, "larger")
    smallest = materialize(larger.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = larger.join(broadcast_if_small(smallest), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    after = materialize(moved.union(smallest.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    discard(least, larger, smallest)
    return after


def _small_round(edges: DataFrame) -> DataFrame:
    """A :func:`_round` as one query, for edges so few that all minima can be broadcast; then edges climb ``JUMPS`` steps.

    A node's smallest neighbour has an edge to its own smallest one, so an edge to the former can lead to the latter instead.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = F.broadcast(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    smallest = F.broadcast(larger.groupBy(F.col("u").alias("from")).agg(F.min("v").alias("to")))
    moved = larger.join(smallest, F.col("u") == F.col("from")).select(F.explode(F.array("u", "v")).alias("u"), F.col("to").alias("v"))
    for _ in range(JUMPS):
        moved = moved.join(smallest, F.col("v") == F.col("from"), "left").select("u", F.coalesce("to", "v").alias("v"))
    return materialize(moved.where("u <> v").distinct(), "edges")


def stars(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) as written, of each node of an edge but the smallest of its component; see :func:`connected_components`."""
    a, b = F.col(src), F.col(dst)
    current = materialize(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    most = BROADCAST_ROWS // 2  # an edge has two nodes
    few = current.limit(most + 1).count() <= most
    for _ in range(max_rounds):
        if _settled(current):
            break
        after = _small_round(current) if few else _round(current)
        discard(current)
        current = after
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))


def with_roots(leaves: DataFrame) -> DataFrame:
    """The rows of :func:`stars`, and a row for the smallest node of each component."""
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): each node of an edge with the smallest node it is connected to.

    Null ends and self loops are ignored; a node without an edge does not appear. Empty input gives an empty result.
    Raises ``RuntimeError`` if ``max_rounds`` rounds do not leave stars (rounds grow with the logarithm of
    the component size).
    """
    return with_roots(stars(edges, src, dst, max_rounds))
