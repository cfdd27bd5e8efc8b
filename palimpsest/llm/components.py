"""Connected components of an edge table, by alternating large and small stars.

Every step is a grouped minimum (pre-aggregated before its shuffle) and an equi-join; no node's neighbours are
gathered in one task and nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.selectExpr("b as a", "a as b"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest of the node and its neighbours. Links may repeat."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").selectExpr("b as a", "m as b").where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.selectExpr("greatest(a, b) as a", "least(a, b) as b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").selectExpr("b as a", "m as b").where("a <> b")
    return moved.unionByName(least.selectExpr("a", "m as b")).distinct()


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: bigint): the smallest node that can be reached.

    The result is a written table that the caller may drop. No edges give no rows; loops and repeated edges change nothing; edges with a null are ignored.
    """
    now = written(edges.where("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        then = written(_small_star(_large_star(now)), "edges")
        drop(now)
        was, mark, now = mark, _mark(then), then
        if was == mark:
            break
    stars = now.selectExpr("a as node", "b as component")
    stars.written_at = now.written_at
    return stars
