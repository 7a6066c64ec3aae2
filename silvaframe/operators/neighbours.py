"""Exact k nearest neighbours and communities of their graph."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .routing import matrix

#: Bytes of one broadcast block of queries; rows that a task compares at once; edges of a graph that the driver may hold.
QUERY_BYTES, RUN_ROWS, EDGES = 16 << 20, 4096, 5_000_000


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between rows of ``a`` and ``b``.

    ``jaccard`` and ``sister`` take rows of 0 and 1 as sets; the sister
    distance is ``1 - (common + least size) / (2 * largest size)``. ``overlap``
    is the sister distance of rows that hold their own place and then the size
    of what they share with the row at each place, themselves included. A zero
    vector has cosine and correlation distance 1, two empty sets distance 0.
    """
    if metric == "euclidean":
        return np.sqrt(np.stack([((b - q) ** 2).sum(1) for q in a]))
    if metric == "cityblock":
        return np.stack([np.abs(b - q).sum(1) for q in a])
    if metric in ("cosine", "correlation"):
        if metric == "correlation":
            a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
        return 1 - np.divide(a @ b.T, size, out=np.zeros(size.shape), where=size > 0)
    if metric == "overlap":
        own, other = (r[:, 0].astype(np.int64) + 1 for r in (a, b))
        common, m, n = a[:, other], a[np.arange(len(a)), own][:, None], b[np.arange(len(b)), other][None]
    else:
        common, m, n = a @ b.T, a.sum(1)[:, None], b.sum(1)[None]
    if metric == "jaccard":
        union = m + n - common
        return 1 - np.divide(common, union, out=np.ones(union.shape), where=union > 0)
    if metric in ("sister", "overlap"):
        top = 2 * np.maximum(m, n)
        return 1 - np.divide(common + np.minimum(m, n), top, out=np.ones(top.shape), where=top > 0)
    raise ValueError("metric is euclidean, cityblock, cosine, correlation, jaccard, sister or overlap")


def _compared(held, k: int, metrics: list[str]):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.float64())])

    def run(batches):
        ids, queries = held.value
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
        for batch in batches:
            for lo in range(0, batch.num_rows, RUN_ROWS):
                part = batch.slice(lo, RUN_ROWS)
                others = part.column(0).to_numpy()
                rows = [matrix(part.column(i + 1)) for i in range(len(metrics))]
                step = max(1, 1_000_000 // len(others))
                for q in range(0, len(ids), step):
                    d = sum(distances(x[q : q + step], r, m) for x, r, m in zip(queries, rows, metrics, strict=True)) / len(metrics)
                    d = np.where(ids[q : q + step, None] == others[None], np.inf, d)
                    for i, row in enumerate(d, q):
                        near = np.flatnonzero(row <= (np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf))
                        near = near[np.isfinite(row[near])]
                        b, s = np.concatenate((best[i][0], others[near])), np.concatenate((best[i][1], row[near]))
                        top = np.lexsort((b, s.round(9)))[:k]
                        best[i] = b[top], s[top]
        size = [len(b) for b, _ in best]
        if sum(size):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, size)), pa.array(np.concatenate([b for b, _ in best])), pa.array(np.concatenate([s for _, s in best]))], schema=schema)

    return run


def knn(rows: DataFrame, k: int, metric: str = "euclidean", second: str | None = None) -> DataFrame:
    """``(a, b, place, distance)``: the ``k`` nearest other rows of each row of ``rows(id, x)``, ties to smaller ids.

    With ``second``, a metric for another column ``x2``, the distance is the
    mean of the two. Every row is a query against all rows: queries go out in
    blocks of bounded size, rows stay where they are. Ids must be unique; an
    empty table gives an empty result, and a row with fewer others gets all.
    Distances that agree to nine places count as ties.
    """
    spark = rows.sparkSession
    metrics = [metric] + ([second] if second else [])
    columns = ["x", "x2"][: len(metrics)]
    data = rows.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("array<double>").alias(c) for c in columns])
    n, *widths = data.select(F.count(F.lit(1)), *[F.max(F.size(c)) for c in columns]).first()
    blocks = max(1, -(-n * (sum(w or 0 for w in widths) + 1) * 8 // QUERY_BYTES))
    order = Window.partitionBy("a").orderBy(F.round("distance", 9), "b")
    out = None
    for block in range(blocks):
        got = data.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        held = spark.sparkContext.broadcast((got["id"].to_numpy(), [matrix(got[c].combine_chunks()) for c in columns]))
        part = data.mapInArrow(_compared(held, k, metrics), "a long, b long, distance double")
        part = part.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)
        out = part if out is None else out.unionByName(part)
    return out.select("a", "b", "place", "distance")


def modularity(edges: np.ndarray, label: np.ndarray, resolution: float = 1.0) -> float:
    """Modularity of a partition of an undirected multigraph, given by rows (a, b, weight); a loop counts twice for its node."""
    w = edges[:, 2]
    total = w.sum()
    if not total:
        return 0.0
    a, b = edges[:, 0].astype(int), edges[:, 1].astype(int)
    degree = np.bincount(a, w, len(label)) + np.bincount(b, w, len(label))
    inside = w[label[a] == label[b]].sum()
    by = np.bincount(label, degree)
    return float(inside / total - resolution * (by**2).sum() / (2 * total) ** 2)


def louvain(edges: np.ndarray, n: int, resolution: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Community of each of ``n`` nodes, numbered by their first node; greedy and the same on each run.

    ``edges`` are rows (a, b, weight) of an undirected multigraph. Nodes move
    to the neighbouring community that raises modularity most (the least number
    on ties) until none does; communities then are nodes of the next level.
    """
    label = np.arange(n)
    while True:
        near: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
        loops, degree = np.zeros(n), np.zeros(n)
        for a, b, w in edges.tolist():
            a, b = int(a), int(b)
            if a == b:
                loops[a] += w
                degree[a] += 2 * w
            else:
                near[a][b] += w
                near[b][a] += w
                degree[a] += w
                degree[b] += w
        total = degree.sum()
        if not total:
            return _renumbered(label)
        own, size = np.arange(n), degree.copy()
        moved = False
        for _ in range(rounds):
            any_ = False
            for i in range(n):
                to: dict[int, float] = defaultdict(float)
                for j, w in near[i].items():
                    to[int(own[j])] += w
                here = int(own[i])
                size[here] -= degree[i]
                best, gain = here, to.get(here, 0.0) - resolution * size[here] * degree[i] / total
                for c in sorted(to):
                    g = to[c] - resolution * size[c] * degree[i] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                size[best] += degree[i]
                if best != here:
                    own[i], any_ = best, True
            moved |= any_
            if not any_:
                break
        if not moved:
            return _renumbered(label)
        kept, own = np.unique(own, return_inverse=True)
        label = own[label]
        a, b = own[edges[:, 0].astype(int)], own[edges[:, 1].astype(int)]
        pairs, back = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0, return_inverse=True)
        edges = np.column_stack((pairs, np.bincount(back.ravel(), edges[:, 2])))
        n = len(kept)


def _renumbered(label: np.ndarray) -> np.ndarray:
    _, first, back = np.unique(label, return_index=True, return_inverse=True)
    rank = np.empty(len(first), int)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[back]


def communities(graph: DataFrame, resolution: float = 1.0) -> dict[int, int]:
    """Community of each node of ``graph(a, b)``, by ``louvain`` over edges that the driver holds; more than ``EDGES`` are an error."""
    got = graph.select(F.col("a").cast("long"), F.col("b").cast("long")).limit(EDGES + 1).toArrow()
    if got.num_rows > EDGES:
        raise ValueError(f"a graph of over {EDGES} edges: cluster a sample and let the others follow their neighbours")
    a, b = got["a"].to_numpy(), got["b"].to_numpy()
    ids, back = np.unique(np.concatenate((a, b)), return_inverse=True)
    if not len(ids):
        return {}
    order = np.lexsort((back[len(a) :], back[: len(a)]))
    edges = np.column_stack((back[: len(a)], back[len(a) :], np.ones(len(a))))[order]
    return dict(zip(ids.tolist(), louvain(edges, len(ids), resolution).tolist(), strict=True))


def cluster_rows(rows: DataFrame, k: int = 10, metric: str = "cosine", resolution: float = 1.0, most: int = 200_000) -> DataFrame:
    """``(id, cluster_id)``: communities of the nearest-neighbour graph of ``rows(id, x)``, numbered from 0.

    Up to ``most`` rows all take part in the graph. Of more, about ``most``
    chosen by a hash of their id do, and every other row goes to the community
    most frequent among its ``k`` nearest of those (the least number on ties).
    """
    spark = rows.sparkSession
    n = rows.count()
    space = 1 << 62
    chosen = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(space)) < F.lit(space if n <= most else max(1, most * space // n))
    found = communities(knn(rows.where(chosen), k, metric), resolution)
    label = spark.createDataFrame([(i, c) for i, c in sorted(found.items())], "id long, cluster_id int")
    if n <= most:
        return rows.select("id").join(label, "id", "left").select("id", F.coalesce("cluster_id", F.lit(0)).alias("cluster_id"))
    core = rows.where(chosen).select("id", "x")
    tagged = knn_to(rows.where(~chosen), core, k, metric).join(label.withColumnRenamed("id", "b"), "b")
    votes = tagged.groupBy("a", "cluster_id").agg(F.count(F.lit(1)).alias("votes"))
    rest = votes.groupBy("a").agg(F.max_by("cluster_id", F.struct("votes", -F.col("cluster_id"))).alias("cluster_id"))
    return label.unionByName(rest.withColumnRenamed("a", "id"))


def knn_to(rows: DataFrame, core: DataFrame, k: int, metric: str) -> DataFrame:
    """``(a, b)``: of each row of ``rows(id, x)`` the ``k`` nearest of a core that is small enough to broadcast."""
    got = core.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")).toArrow()
    held = rows.sparkSession.sparkContext.broadcast((got["id"].to_numpy(), matrix(got["x"].combine_chunks())))

    def run(batches):
        ids, x = held.value
        for batch in batches:
            mine = matrix(batch.column(1))
            for lo in range(0, batch.num_rows, 64):
                d = distances(mine[lo : lo + 64], x, metric).round(9)
                top = np.stack([np.lexsort((ids, row))[:k] for row in d])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy()[lo : lo + 64], top.shape[1])), pa.array(ids[top].ravel())], names=["a", "b"])

    return rows.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")).mapInArrow(run, "a long, b long")
