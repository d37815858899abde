"""Connected components of an edge table.

Alternates the large-star and small-star steps until no edge changes: the
large step links every larger neighbour of a vertex to the smallest one
around it, the small step does so with the smaller neighbours.  Edges end as
stars on the smallest vertex of each component, after a number of rounds
logarithmic in the number of vertices; there is no cap on rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscope.session import reliable_checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.filter(F.col("b") > F.col("a")).join(low, "a")
            .filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = (down.join(low, "a").filter(F.col("b") != F.col("m"))
             .select(F.col("b").alias("a"), F.col("m").alias("b")))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str | Column = "src", b: str | Column = "dst") -> DataFrame:
    """(id, component): the smallest vertex reachable from each vertex that
    has an edge to another one.

    ``edges`` may hold loops, nulls, repeats and both directions; loops and
    nulls count for nothing, an empty table gives an empty table.  Every
    round is checkpointed, so a lost executor costs one round at most.
    """
    def col(c):
        return F.col(c) if isinstance(c, str) else c

    now = reliable_checkpoint(
        edges.select(F.greatest(col(a), col(b)).alias("a"), F.least(col(a), col(b)).alias("b"))
        .filter(col(a).isNotNull() & col(b).isNotNull() & (col(a) != col(b))).distinct())

    def state(e: DataFrame) -> tuple:
        # order-free digest of the edge set; a vertex with one edge is settled
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(now)
    while before[0]:
        now = reliable_checkpoint(_small_star(_large_star(now)))
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
