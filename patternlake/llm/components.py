"""Connected components of a graph that lies in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), longs, in either direction, repeats and loops allowed. Returns node, root for every node with an edge to another; root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour if that is smaller, follows the hooks to their ends by
    doubling, and contracts the edges to these ends, which at least halves the nodes that still have edges. All steps
    are joins with a table of unique keys, in which a node that very many others lead to is dealt over many tasks, and
    minima that are combined before they are shuffled: no node's neighbours meet in one task.
    """
    left = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    roots = cut(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select("node", F.col("node").alias("root")))
    while not left.isEmpty():
        hooks = cut(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        while True:  # every hook leads to a smaller node, so the paths end
            jump = spread_join(hooks, hooks.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left")
            jumped = cut(jump.select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
            hooks = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        roots = cut(spread_join(roots, hooks.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        ends = spread_join(left, hooks.select(F.col("node").alias("a"), F.col("up").alias("x")), "a", "left")
        ends = spread_join(cut(ends), hooks.select(F.col("node").alias("b"), F.col("up").alias("y")), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        left = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    return roots
