"""Connected components of an edge table by alternating stars, wholly as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, join_by_count


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with m, the least v of each u; the rows of a heavy u, such as a star's centre, stay where they are."""
    return join_by_count(rows, rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), ["u"], total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node links its larger neighbours to the least node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _with_least(both, 2 * total).where(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of those."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return _with_least(down, total).select(near.alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (u, v); component is the least node that is reachable.

    A round keeps at most one row an edge and ends when the edges are stars around least nodes. Each step is written
    to the shared folder, so a round lost with an executor is read again rather than computed from the start.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    count, mark = now.count(), None
    for _ in range(most_rounds):
        now = cut(_large_star(now, count).where("u <> v").distinct())
        now = cut(_small_star(now, now.count()).where("u <> v").distinct())
        count, found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if (count, found) == mark:
            leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return leaves.unionByName(roots)
        mark = (count, found)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
