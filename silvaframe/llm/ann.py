"""Approximate nearest neighbours by multiprobe p-stable hashing with exact reranking.

A table hashes a vector to the cells ``floor((a_i . x + b_i) / w)`` of a few
Gaussian ``a_i`` (Datar et al. 2004); a bucket is a tuple of cells. A query
visits its own bucket and perturbed ones, in which some cells are one to the
left or right. Perturbation sets are generated once for all queries, best
first, over the ranks of the query's distances to its cells' bounds (Lv et al.
2007, precomputed sequence), so no bucket that isn't visited is ever looked at.
Each has an estimated success probability: that a neighbour at the expected
distance falls into it. Buckets of all tables are visited by falling
probability until together they reach ``TARGET``; the candidates of all tables
are merged and ranked by exact distance.

Hash functions are the same for all rows and queries. Their width follows the
expected distance of the k-th neighbour, measured on a bounded sample of rows.
Every row is indexed; a bucket's key is a linear hash of its cells, so a probe
is one addition. Nothing caps candidates; queries that are left with too few
are answered by comparing them with every row.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .blocked import blocked_topk, matrix, own_places, usable
from .kernels import U, mix
from .sample import about

#: Tables, hashes of a table, perturbation sets of a table, cell width in expected distances, success wanted.
TABLES, HASHES, SETS, WIDTH, TARGET = 16, 16, 1024, 2.5, 0.85
#: Rows on which the expected distance is measured, at most about; of them queries; rows of a run.
SAMPLE, ASKED, RUN = 4096, 64, 65536


def _normal(x: np.ndarray) -> np.ndarray:
    """Distribution function of the normal law, within 0.01."""
    return 1 / (1 + np.exp(np.clip(-1.702 * x, -60, 60)))


def perturbations(hashes: int, most: int) -> np.ndarray:
    """The ``most`` best sets, best first, as rows over the ranks of the 2 * ``hashes`` distances to cell bounds.

    A rank's cost is its expected squared distance for a query anywhere in its
    cell; a set can't move one cell both ways.
    """
    m, n = hashes, 2 * hashes
    j = np.arange(1, n + 1)
    far = (n + 1 - j) / (m + 1)
    cost = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - far + far * (n + 2 - j) / (4 * (m + 2))).tolist()
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < most:
        c, ranks = heapq.heappop(heap)
        if not any(n - 1 - r in ranks for r in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < n:
            heapq.heappush(heap, (c + cost[last + 1], (*ranks, last + 1)))
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
    sets = np.zeros((len(out), n), bool)
    for i, ranks in enumerate(out):
        sets[i, list(ranks)] = True
    return sets


class Hashing:
    """The hash functions of all tables and the order in which a query visits buckets."""

    def __init__(self, dim: int, radius: float, tables: int = TABLES, hashes: int = HASHES, sets: int = SETS, width: float = WIDTH, target: float = TARGET, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.tables, self.hashes, self.width, self.target = tables, hashes, width, target
        self.a = rng.standard_normal((dim, tables * hashes)) / (width * radius)
        self.b = rng.random(tables * hashes)
        self.step = mix(np.arange(1, hashes + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
        self.sets = perturbations(hashes, sets)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return x @ self.a + self.b

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """Bucket of each row in each table."""
        whole = np.clip(np.floor(cells), -(2.0**62), 2.0**62).astype(np.int64).view(U).reshape(len(cells), self.tables, self.hashes)
        return (whole * self.step).sum(2, dtype=U)

    def index(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each table the sorted keys of rows ``x`` and their places."""
        keys = self.keys(self.cells(x))
        order = np.argsort(keys, axis=0, kind="stable")
        return [(keys[order[:, t], t], order[:, t]) for t in range(self.tables)]

    def visits(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(table, key) of the buckets that one query visits, by falling estimated success."""
        at = cells.reshape(self.tables, self.hashes)
        right = at - np.floor(at)  # distance to the left bound; in widths
        edge = [_normal((e - right) * self.width) for e in (-1, 0, 1, 2)]
        down, own, up = (np.log(np.maximum(hi - lo, 1e-12)) for lo, hi in zip(edge[:-1], edge[1:], strict=True))
        order = np.argsort(np.concatenate((right, 1 - right), 1), axis=1)
        gain = np.take_along_axis(np.concatenate((down - own, up - own), 1), order, 1)
        move = np.concatenate((U(0) - self.step, self.step))[order]
        chance = np.exp(own.sum(1)[:, None] + gain @ self.sets.T.astype(float))
        key = self.keys(cells[None])[0][:, None] + np.stack([(self.sets * m).sum(1, dtype=U) for m in move])
        order = np.argsort(-chance, axis=None, kind="stable")
        table = order // len(self.sets)
        chance = chance.ravel()[order]
        less = np.empty(len(order))  # by each visit, of the log of the chance that every table misses
        for t in range(self.tables):
            mine = table == t
            less[mine] = np.diff(np.log1p(-np.minimum(np.cumsum(chance[mine]), 1 - 1e-9)), prepend=0.0)
        enough = int(np.searchsorted(-np.cumsum(less), -np.log1p(-self.target))) + 1
        return table[:enough], key.ravel()[order[:enough]]

    def candidates(self, index, cells: np.ndarray, n: int) -> np.ndarray:
        """Whether each of the ``n`` rows of ``index`` is in a bucket that the query visits."""
        table, key = self.visits(cells)
        near = np.zeros(n, bool)
        for t, (keys, place) in enumerate(index):
            mine = key[table == t]
            first, last = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            size = last - first
            near[place[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
        return near


def expected_distance(sample: np.ndarray, n: int, k: int) -> float:
    """Distance within which three quarters of ``n`` rows have their k-th neighbour, from a sample of them; copies don't count."""
    if len(sample) < 2:
        return 1.0
    rank = max(0, round(k * len(sample) / max(n, 1)) - 1)
    found = []
    for q in sample[:ASKED]:
        d = np.sort(((sample - q) ** 2).sum(1))
        d = d[d > 1e-12 * max(1.0, float(q @ q))]
        if len(d):
            found.append(np.sqrt(d[min(rank, len(d) - 1)]))
    return float(np.quantile(found, 0.75)) if found else 1.0


def _nearest(x: np.ndarray, norms: np.ndarray, found: np.ndarray, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and negative exact distances of what may be among the ``k`` nearest of ``found``."""
    if len(found) > k:  # a fast bound first, then the exact distance of what is left
        rough = norms[found] - 2 * (x[found] @ q)
        slack = 1e-9 * (float(norms.max(initial=0)) + float(q @ q))
        found = found[rough <= min(np.partition(rough, k - 1)[k - 1], least**2 - float(q @ q)) + slack]
    return found, -np.sqrt(((x[found] - q) ** 2).sum(1))


def multiprobe_unit(hashing: Hashing, k: int):
    """The ranking of one run for ``blocked_topk``."""

    def unit(rows, x, query_rows, queries, least):
        index, norms, places, cells = hashing.index(x), (x**2).sum(1), own_places(rows, query_rows), hashing.cells(queries)
        for i, q in enumerate(queries):
            near = hashing.candidates(index, cells[i], len(x))
            if places[i] >= 0:
                near[places[i]] = False
            yield i, *_nearest(x, norms, np.flatnonzero(near), q, k, least[i])

    return unit


def exact_unit(k: int):
    """The ranking of one run by comparing each query with every row."""

    def unit(rows, x, query_rows, queries, least):
        norms, places, every = (x**2).sum(1), own_places(rows, query_rows), np.arange(len(x))
        for i, q in enumerate(queries):
            yield i, *_nearest(x, norms, every[every != places[i]], q, k, least[i])

    return unit


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, **index) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest found, by Euclidean distance.

    Candidates are all rows but the query's own; ties go to the smaller vec_id.
    Null ids take no part, nor do vectors that are null, zero, empty, or hold a
    null or non-finite component. Rows that repeat an id are rows of their own,
    as queries and as candidates. Shorter vectors are filled up with zeros. An
    empty table gives an empty result; other columns are ignored.
    """

    def prepared(rows, n):
        width = rows.select(F.max(F.size("v"))).first()[0] or 1
        sample = matrix(about(rows, "row", n, SAMPLE).select("v").toArrow()["v"], width)
        return multiprobe_unit(Hashing(width, expected_distance(sample, n, k), **index), k), exact_unit(k)

    return blocked_topk(usable(vectors, False), is_query, k, prepared, -F.col("score"), run_rows=RUN)
