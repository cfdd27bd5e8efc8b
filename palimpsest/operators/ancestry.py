"""Walks from headers to their ancestors by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folder import drop, written


def walk(edges: DataFrame, stops: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, terminal, depth, kind) for each node of ``edges`` (node, prev), one row per node.

    A walk ends at the first ancestor in ``stops`` (node, kind), or at a node without an edge (kind dangling).
    Each round joins the pointers with themselves and doubles their reach; a walk that is still open when its reach
    exceeds the number of nodes runs in a circle (kind cycle, terminal and depth null).
    """
    marks = stops.select(F.col("node").alias("prev"), F.col("kind").alias("_kind"))
    own = edges.select(F.col("node").alias("prev"), F.lit(1).alias("_has"))
    now = edges.join(marks, "prev", "left").join(own, "prev", "left")
    kind = F.when(F.col("_kind").isNotNull(), F.col("_kind")).when(F.col("_has").isNull(), "dangling")
    now = written(now.select("node", F.col("prev").alias("terminal"), F.lit(1).cast("bigint").alias("depth"), kind.alias("kind")), "walk")
    nodes = now.count()
    for turn in range(rounds):
        if not now.where("kind is null").limit(1).count() or 1 << turn > nodes:
            break
        onward = now.select(F.col("node").alias("terminal"), F.col("terminal").alias("_t"), F.col("depth").alias("_d"), F.col("kind").alias("_k"))
        open_walks = now.where("kind is null").join(onward, "terminal").select("node", F.col("_t").alias("terminal"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_k").alias("kind"))
        was, now = now, written(now.where("kind is not null").unionByName(open_walks), "walk")
        drop(was)
    circle = F.col("kind").isNull()
    return now.select("node", F.when(~circle, F.col("terminal")).alias("terminal"), F.when(~circle, F.col("depth")).alias("depth"), F.coalesce("kind", F.lit("cycle")).alias("kind"))
