"""Routing of whole vectors through grown trees, as NumPy over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of node arrays that one pass over the samples broadcasts, at most; further trees are another pass.
ROUTE_BYTES = 64 << 20


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The vectors of a list column as rows of one matrix; all have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, width or 0))


class Router:
    """Node arrays of some trees: a test is ``sum((x[f] - mean) * score) > split``, equal scores go left.

    ``nodes`` are rows ``(id, left id, right id, features, scores, means, split)``
    of inner nodes and ``(id, None, ...)`` of leaves; ``roots`` are the trees'
    root ids. With ``row_sum_scaling`` a score is divided by the sum of the raw
    values of its features (0 where that is 0).
    """

    def __init__(self, nodes: list[tuple], roots: list[int], row_sum_scaling: bool = False) -> None:
        place = {n[0]: i for i, n in enumerate(nodes)}
        self.ids = np.array([n[0] for n in nodes], np.int64)
        self.left = np.array([place[n[1]] if n[1] is not None else -1 for n in nodes], np.int32)
        self.right = np.array([place[n[2]] if n[1] is not None else -1 for n in nodes], np.int32)
        self.split = np.array([n[6] for n in nodes], float)
        some = [n[3] if n[1] is not None else () for n in nodes]
        self.size = np.array([len(f) for f in some], np.int32)
        self.feature = np.array([f[0] if len(f) else 0 for f in some], np.int32)
        self.score = np.array([n[4][0] if len(f) else 0.0 for n, f in zip(nodes, some, strict=True)], float)
        self.mean = np.array([n[5][0] if len(f) else 0.0 for n, f in zip(nodes, some, strict=True)], float)
        self.wide = {i: (np.array(n[3], np.int64), np.array(n[4], float), np.array(n[5], float)) for i, (n, f) in enumerate(zip(nodes, some, strict=True)) if len(f) > 1}
        self.roots = np.array([place[r] for r in roots], np.int32)
        self.row_sum_scaling = row_sum_scaling

    @classmethod
    def of(cls, state: dict) -> Router:
        """The router whose ``__dict__`` was sent; plain arrays can be read where this package isn't installed."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def scores(self, at: int, x: np.ndarray) -> np.ndarray:
        features, scores, means = self.wide[at]
        return weighed(x[:, features], scores, means, self.row_sum_scaling)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Ids of the leaf that each row reaches in each tree."""
        n = len(x)
        out = np.empty((n, len(self.roots)), np.int64)
        rows = np.arange(n)
        for t, root in enumerate(self.roots):
            at = np.full(n, root, np.int32)
            live = rows
            while len(live):
                live = live[self.left[at[live]] >= 0]
                if not len(live):
                    break
                here = at[live]
                value = x[live, self.feature[here]]
                score = (value - self.mean[here]) * self.score[here]
                if self.row_sum_scaling:
                    score = _over(score, value)
                score = np.where(self.size[here] > 0, score, 0.0)
                if self.wide:
                    for k in np.unique(here[self.size[here] > 1]).tolist():
                        mine = here == k
                        score[mine] = self.scores(k, x[live[mine]])
                at[live] = np.where(score > self.split[here], self.right[here], self.left[here])
            out[:, t] = self.ids[at]
        return out


def weighed(values: np.ndarray, scores: np.ndarray, means: np.ndarray, row_sum_scaling: bool) -> np.ndarray:
    """Linear score of each row, added up feature by feature: the same to the last bit wherever it is computed."""
    out, total = np.zeros(len(values)), np.zeros(len(values))
    for j in range(values.shape[1]):
        out += (values[:, j] - means[j]) * scores[j]
        total += values[:, j]
    return _over(out, total) if row_sum_scaling else out


def _over(score: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.divide(score, total, out=np.zeros_like(score), where=total != 0)


def groups(trees: list[list[tuple]], most: int = ROUTE_BYTES) -> list[list[int]]:
    """Numbers of trees in groups whose node arrays stay under ``most`` bytes (a group has one tree at least)."""
    out: list[list[int]] = []
    size = most
    for t, nodes in enumerate(trees):
        own = sum(96 + 24 * len(n[3]) for n in nodes)
        if not out or size + own > most:
            out.append([])
            size = 0
        out[-1].append(t)
        size += own
    return out
