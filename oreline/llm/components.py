"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _lowest(edges: DataFrame, rows: int) -> DataFrame:
    """Each a's smallest neighbour; cut, so that the join with it can split a hub's rows."""
    return cut(edges.groupBy("a").agg(F.min("b").alias("low")), rows)


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (a, b), b the smallest node that a reaches, for every node a that isn't that node itself.

    ``edges`` has columns a and b of one type, in any direction; loops and repeats are
    allowed. Each round joins the edges with each node's least neighbour, so a
    hub's rows are only aggregated and looked up, never gathered in one task.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _lowest(both, 2 * before[0]).select("a", F.least("a", "low").alias("low"))
        large = cut(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), 2 * before[0])
        low = _lowest(large, 2 * before[0])
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = cut(small.unionAll(low.select("a", F.col("low").alias("b"))).distinct(), 2 * before[0])
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges
