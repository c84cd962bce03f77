"""Connected components of a distributed edge list, by alternating star contraction.

Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014) with aggregates and joins only: no neighbour list is ever
collected, so a node with very many neighbours costs a partial minimum per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoweave.llm.base import few, gathered, shuffles_freed

MAX_ROUNDS = 60
#: Edges up to which least neighbours are broadcast.
FEW = 1 << 18


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, stored, by as many tasks as they ask for; their number and digests."""
    e, rows = few(edges)
    with shuffles_freed(edges.sparkSession):
        return e, (rows, *e.agg(F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).first())


def _met(x: DataFrame, low: DataFrame, rows: int) -> DataFrame:
    """x with the row of low(k, m) of each u; of few rows, low is broadcast."""
    return x.join(F.broadcast(low) if rows <= FEW else low, F.col("u") == F.col("k"))


def _both(x: DataFrame, y: DataFrame, rows: int) -> DataFrame:
    return gathered(x.unionByName(y), rows)  # a union of two tables in one partition each has two


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges(a, b); component is its smallest node.

    Loops and repeated edges are allowed. No edges give an empty result.
    """
    e, state = _stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            break
        both = _both(e, e.select(F.col("v").alias("u"), F.col("u").alias("v")), 2 * state[0])
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = _met(both.filter("v > u"), low, state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = _met(large, low.withColumnRenamed("u", "k"), state[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = state
        e, state = _stored(_both(moved, low.select("u", F.col("m").alias("v")), 2 * last[0]).distinct())
        if state == last:
            break
    else:
        raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
