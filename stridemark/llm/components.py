"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, split_hot


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Each edge (u, v) with the smallest neighbour ``m`` of u; edges of a star's centre are not gathered."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("u", "k")
    return join_hot(edges, lambda: F.col("u") == F.col("k"), *split_hot(least, total)).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node reachable.

    Each round links a node's larger neighbours to its smallest neighbour, then its smaller
    neighbours and itself; the number of edges never grows and the rounds are logarithmic in the
    longest path. Every round is written to the shared checkpoint folder. Nulls in u or v are
    ignored, an empty table has no components.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(e)
    while before[0]:
        both = _with_least(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * before[0])
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        joined = _with_least(large, before[0])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        if (now := _mark(e)) == before:
            break
        before = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
