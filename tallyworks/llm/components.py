"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is one or two group-bys by vertex. A vertex with very many links is no special case: neighbours are
reduced to a minimum by a partial aggregate, and no step gathers a neighbourhood. Every round is written to the
shared folder, so a lost executor costs one round at most, and the round before it is deleted. The number of rounds grows with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every neighbour above a vertex is linked to the vertex's smallest; small: every one at or below it."""
    if large:
        e = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
    j = e.join(low, F.col("a") == F.col("v"))
    if large:
        out = j.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """vertex, component for every vertex of edges (a, b): component is the smallest vertex that it can reach."""
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        last, e = e, cut(_star(_star(e, True), False))
        drop(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(e.select("b", "b")).distinct()
