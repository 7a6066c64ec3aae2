"""Paths through trees and orders of nodes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import linear_score
from .forest import Forest
from .neighbours import distances
from .order import row_numbers


def path_vectors(forest: Forest) -> DataFrame:
    """``(node_id, path)``: the nodes on the way from the root, the node last."""
    down = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor_id")))
    return forest.path.groupBy("node_id").agg(F.transform(down, lambda s: s["ancestor_id"]).alias("path"))


def consensus_levels(forest: Forest, clusters: DataFrame) -> DataFrame:
    """``(cluster_id, level, ancestor_id, share)``: which ancestors a cluster's nodes have, as shares of its nodes."""
    at = clusters.join(forest.path, "node_id").join(forest.nodes.select(F.col("node_id").alias("ancestor_id"), "level"), "ancestor_id")
    n = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return at.groupBy("cluster_id", "level", "ancestor_id").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n), "cluster_id").select("cluster_id", "level", "ancestor_id", (F.col("k") / F.col("n")).alias("share"))


def sorted_nodes(forest: Forest, samples: DataFrame) -> DataFrame:
    """``(node_id, sample_id, value, place)``: samples of each inner node by the score of its test, ties by id.

    Inner nodes are few, but a root has all samples; places are found by
    ranges of values, so none of them is one task's work.
    """
    kids = forest.nodes.where("parent_id is not null and lr = 0").select(F.col("parent_id").alias("node_id"), "features", "scores", "means")
    at = forest.members(samples).join(Forest._small(kids, len(forest.rows) * 100), "node_id").join(samples.select("sample_id", "x"), "sample_id")
    scored = at.select("node_id", "sample_id", linear_score(F.col("x"), F.col("features"), F.col("scores"), F.col("means")).alias("value"))
    return row_numbers(scored, ["node_id"], "value", "sample_id").select("node_id", "sample_id", "value", F.col("p").alias("place"))


def average_linkage(x: np.ndarray, metric: str = "euclidean") -> list[int]:
    """Rows in the leaf order of an average-linkage dendrogram: the two nearest groups join first, the one with the smaller row comes first.

    For tables of clusters or nodes, which the driver holds: quadratic in rows.
    """
    n = len(x)
    if n < 2:
        return list(range(n))
    d = distances(x, x, metric)
    np.fill_diagonal(d, np.inf)
    order: dict[int, list[int]] = {i: [i] for i in range(n)}
    size = np.ones(n)
    live = np.ones(n, bool)
    for _ in range(n - 1):
        some = np.flatnonzero(live)
        sub = d[np.ix_(some, some)]
        a, b = (int(some[k]) for k in np.unravel_index(np.argmin(sub), sub.shape))
        a, b = min(a, b), max(a, b)
        order[a] += order.pop(b)
        d[a] = d[:, a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a, a] = np.inf
        size[a] += size[b]
        live[b] = False
    return next(iter(order.values()))


def biclustered(table: np.ndarray, metric: str = "euclidean") -> tuple[list[int], list[int]]:
    """Orders of rows and columns of a matrix by average linkage of either."""
    return average_linkage(table, metric), average_linkage(table.T, metric)
