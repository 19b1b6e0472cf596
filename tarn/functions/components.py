"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.plans.scratch import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """Label every vertex that has an edge with the smallest vertex it can reach.

    ``edges`` holds undirected links between ``long`` vertices; loops, repeats and nulls are ignored.
    Returns ``(vertex, component)``; an empty input gives an empty result. A round hangs every vertex
    below the least of its neighbours (large star), then hangs those neighbours below one another
    (small star), so the number of rounds grows with the logarithm of the longest path. The least
    neighbour comes from a partial aggregate and a join that adaptive execution may split, so a vertex
    with very many links is never gathered in one task.

    Raises ``RuntimeError`` if the labels have not settled after ``rounds`` rounds.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    now = (
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    now = cut(now, "edges")
    before = None
    for _ in range(rounds):
        state = _state(now)
        if state == before or not state[0]:
            break
        before = state
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        # as a table its size is known: it is broadcast, or joined in a way that splits a vertex of very many links
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = (
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
            .join(least, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .where("hi != lo")
            .distinct()
        )
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(below, "hi")
            .select(F.greatest("lo", "m").alias("hi"), F.least("lo", "m").alias("lo"))
            .where("hi != lo")
            .unionAll(below.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        now = cut(small, "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = now.select(F.col("hi").alias("vertex"), F.col("lo").alias("component"))
    return leaves.unionAll(now.select(F.col("lo").alias("vertex"), F.col("lo").alias("component")).distinct())
