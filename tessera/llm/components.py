"""Distributed union-find: connected components of an edge table with DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.cut import cut

MOST_ROUNDS = 100


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """`node` and `component` (the smallest node that its links reach) of every node in an edge.

    Stars are rewired in rounds: every node hangs its larger neighbours under its smallest one, then the same
    for its smaller neighbours. The number of rounds grows with the logarithm of the longest chain. Minima are
    taken before the shuffle, and a node of many links is only joined with its one minimum, a join that can be
    split. Each round is a written table. Loops, repeated edges and null ends are ignored; no edges, no rows.
    """
    links = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    stars = cut(links.distinct())
    before = _state(stars)
    for _ in range(MOST_ROUNDS):
        if before[0] == 0:
            break
        stars = cut(_under_smallest(_over_larger(stars)))
        now = _state(stars)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _state(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _over_larger(stars: DataFrame) -> DataFrame:
    both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _under_smallest(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("a").agg(F.min("b").alias("m"))
    moved = stars.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
