"""Connected components of an edge table, and joins on keys that may be hot."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def shares(df: DataFrame, total: int) -> int:
    """The rows of one key that are too many for one task: half of a task's share, 16 at least."""
    return max(16, total // (2 * max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def lookup(rows: DataFrame, table: DataFrame, key: str, number: str, total: int) -> DataFrame:
    """rows joined with table, one row a key, by the key that both name.

    table's column `number` says how many of the `total` rows a key has; it is
    dropped. Keys with more than a task's share are joined by broadcast, so that
    none is gathered in one task: they are twice as many as partitions at most."""
    most = shares(rows, total)
    light, heavy = table.where(F.col(number) <= most).drop(number), table.where(F.col(number) > most).drop(number)
    spread = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return spread.unionByName(rows.join(F.broadcast(heavy), key))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges between values, (value, smallest value linked to it) for all that are not it."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), root the smallest of its component.

    Large-star and small-star steps in turn, each round written to the shared
    folder; rounds grow with the logarithm of the longest path. A hub's edges
    stay where they are and meet its smallest neighbour by broadcast. Loops,
    repeated and reversed edges are harmless."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark, total = new, new["n"]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        large = lookup(now.select(F.col("b").alias("a"), F.col("a").alias("b")), least, "a", "n", total).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = lookup(large, low, "a", "n", total).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
