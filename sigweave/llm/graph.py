"""Joins that leave no key to one task, and connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of more than 1 / HOT of all rows are HOT at most, whatever the size. A task of components() has about EACH edges.
HOT, FEW, EACH = 1000, 64, 50_000


def meet(rows: DataFrame, one: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with `one`, which has a row for each key; its column `count` says how many of the `total` rows have it.

    The keys with more than total / HOT rows, HOT at most, are broadcast, so that their rows stay where they are; the
    others are met by shuffle. Keys that `one` lacks are left out.
    """
    limit = max(FEW, total // HOT)
    hot, cold = one.where(F.col(count) > limit), one.where(F.col(count) <= limit)
    at_once = rows.join(F.broadcast(hot), key)
    return at_once.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b); a component is named by its least node.

    Large-star and small-star steps in turn, until the edges are stars around least nodes;
    the edges before the first turn and after each are written to the checkpoint folder. Loops and repeated
    edges do no harm; no edges give no nodes. A turn makes no edges more, so the tasks follow from the edges at first:
    each task of each turn writes files, and a small graph dealt over all shuffle partitions fills the disk with them.
    """
    state, last = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint(), None
    tasks = -(-state.count() // EACH) or 1
    state = state.coalesce(tasks)
    while True:
        both = state.union(state.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").coalesce(tasks).distinct()
        state = small.coalesce(tasks).checkpoint()
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(state.select("b", "b").distinct())
