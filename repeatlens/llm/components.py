"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlens.llm.common import settled

EDGES = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component``, the smallest id reachable, of every end of ``edges`` (a, b: long).

    Alternates large-star and small-star steps (Kiveris and others, 2014): each vertex hands
    its neighbours to its smallest neighbour, until the edges form stars. The number of
    rounds grows with the logarithm of the longest path. Every step is a minimum that is
    combined before the shuffle, and a join. Each round is cut off at a checkpoint, of which
    a task reads ``EDGES``; edges that form stars already take none. The driver sees one row
    a round.
    """
    star = settled(
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w"))
        .filter("v > w")
        .distinct()
    )
    while True:
        ends, broken = _looked_over(star)
        if not broken:
            break
        read = star.coalesce(ends // (2 * EDGES) + 1)
        star = settled(_small_star(_large_star(read)))
    leaf = F.struct(F.col("v").alias("id"), F.col("w").alias("component"))
    centre = F.struct(F.col("w").alias("id"), F.col("w").alias("component"))
    return star.select(F.inline(F.array(leaf, centre))).distinct()


def _both_ways(star: DataFrame) -> DataFrame:
    """Every edge from either end, from one pass over the edges."""
    back = F.struct(F.col("w").alias("v"), F.col("v").alias("w"))
    return star.select(F.inline(F.array(F.struct("v", "w"), back)))


def _looked_over(star: DataFrame) -> tuple[int, int]:
    """Ends of edges, and the vertices that have a smaller neighbour beside another one:
    stars have none."""
    seen = _both_ways(star).groupBy("v").agg(F.min("w").alias("least"), F.count(F.lit(1)).alias("m"))
    ends = F.coalesce(F.sum("m"), F.lit(0))
    return tuple(seen.agg(ends, F.count_if(F.expr("least < v AND m > 1"))).first())


def _large_star(star: DataFrame) -> DataFrame:
    """Every vertex links its larger neighbours to its smallest one."""
    both = _both_ways(star)
    least = both.groupBy("v").agg(F.min("w").alias("least"))
    least = least.select("v", F.least("v", "least").alias("least"))
    return (
        both.join(least, "v")
        .filter("w > v")
        .select(F.col("w").alias("v"), F.col("least").alias("w"))
        .distinct()
    )


def _small_star(star: DataFrame) -> DataFrame:
    """Every vertex links its smaller neighbours, and itself, to its smallest one."""
    least = star.groupBy("v").agg(F.min("w").alias("least"))
    neighbour = F.struct(F.col("w").alias("v"), F.col("least").alias("w"))
    itself = F.struct("v", F.col("least").alias("w"))
    return star.join(least, "v").select(F.inline(F.array(neighbour, itself))).filter("v > w").distinct()
