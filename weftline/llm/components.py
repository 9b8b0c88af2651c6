"""Connected components of an edge table by alternating large and small stars, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, join_hot, materialize, partitions

#: Edges that a hub's row meets in one task, at least.
HUB = 1000


def _with_least(neighbours: DataFrame, n: int) -> DataFrame:
    """``neighbours`` (u, v), about ``n``, plus m, the least v of u. A hub's edges are dealt out over copies of its row; a node is one
    above a share of all edges that leaves no more hubs than a few for each partition."""
    low = neighbours.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    parts = partitions(neighbours.sparkSession)
    most = max(HUB, n // (4 * parts))
    if n <= HUB:
        return neighbours.join(low.drop("n"), "u")
    return join_hot(neighbours, low.drop("n"), "u", low.where(F.col("n") > most).select("u", "n"), n // most + 1, most)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    met = _with_least(both, 2 * n).withColumn("m", F.least("u", "m"))
    return met.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    met = _with_least(down, n)
    moved = met.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionByName(down.groupBy("u").agg(F.min("v").alias("a")).select("a", F.col("u").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b), a <> b, that are not the least of their component; the component is its
    least node."""
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    before = None
    while (state := _state(now)) != before:
        before, old = state, now
        now = materialize(_small_star(_large_star(now, state[0]), state[0]), "edges")
        discard(old)
    return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
