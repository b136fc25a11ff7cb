"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import drop, join_hot, keep


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """Point the larger (or the smaller and equal) neighbours of each node at its least one.

    Least neighbours come from an aggregate and go back by a join, so no neighbour list
    is ever gathered; hubs go back by a broadcast.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        out = join_hot(both.where("b > a"), least, ["a"], "n", 2 * rows).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        out = join_hot(down, least, ["a"], "n", rows).select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node reachable, for every node of edges (a, b); longs without nulls."""
    state = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "graph")
    before = None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == mark or not mark[0]:
            break
        before, old = mark, state
        half = keep(_star(old, True, mark[0]), "graph")
        state = keep(_star(half, False, mark[0]), "graph")
        drop(old, half)
    own = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    return own.join(state, own["node"] == state["a"], "left").select("node", F.coalesce("b", "node").alias("component"))
