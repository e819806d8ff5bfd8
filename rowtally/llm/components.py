"""Connected components of a stored edge list, and of small local ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtally.session import scratch_folder, stored


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for nodes of a local edge list whose root, the smallest node reachable, is another node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _with_least(edges: DataFrame, key: str, least: DataFrame, total: int) -> DataFrame:
    """Edges joined with ``least`` (_k, _m, _n). Keys with over a thousandth of the edges are at most 2,000: these are
    broadcast, so that a hub's edges needn't meet in one task."""
    limit = max(100, total // 1000)
    hot = F.broadcast(least.filter(F.col("_n") > limit).select("_k", F.col("_m").alias("_hot")))
    marked = edges.join(hot, edges[key] == hot["_k"], "left").drop("_k")
    cold = least.filter(F.col("_n") <= limit).select("_k", "_m")
    rest = marked.filter("_hot IS NULL").drop("_hot")
    return marked.filter("_hot IS NOT NULL").withColumnRenamed("_hot", "_m").unionByName(rest.join(cold, rest[key] == cold["_k"]).drop("_k"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    ends = edges.select(F.col("lo").alias("_k"), F.col("hi").alias("_v")).unionByName(edges.select(F.col("hi").alias("_k"), F.col("lo").alias("_v")))
    least = ends.groupBy("_k").agg(F.min("_v").alias("_m"), F.count(F.lit(1)).alias("_n")).withColumn("_m", F.least("_k", "_m"))
    return _with_least(edges, "lo", least, total).select("hi", F.col("_m").alias("lo")).filter("hi > lo").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy(F.col("hi").alias("_k")).agg(F.min("lo").alias("_m"), F.count(F.lit(1)).alias("_n"))
    moved = _with_least(edges, "hi", least, total).filter("lo > _m").select(F.col("lo").alias("hi"), F.col("_m").alias("lo"))
    return moved.unionByName(least.select(F.col("_k").alias("hi"), F.col("_m").alias("lo"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge to another: the smallest node reachable.

    Alternates large and small stars until the edges stay the same; each round's edges are a stored table, so that plans
    stay short and lost executors cost a round at most. Nothing but a count and a checksum reaches the driver.
    """
    spark = edges.sparkSession
    mark = (F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 31))).alias("h"))
    now = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi > lo").distinct()
    now = stored(now, scratch_folder(spark, "edges"))
    seen = tuple(now.agg(*mark).first())
    while seen[0]:
        large = stored(_large_star(now, seen[0]), scratch_folder(spark, "edges"))
        now = stored(_small_star(large, seen[0]), scratch_folder(spark, "edges"))
        before, seen = seen, tuple(now.agg(*mark).first())
        if seen == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
