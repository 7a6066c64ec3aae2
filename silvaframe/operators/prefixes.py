"""Order statistics of every prefix of a column at once, in time that grows like n log n (the MAD: n log² n)."""

from __future__ import annotations

from functools import cached_property

import numpy as np

#: Prefixes that step together, so that what they look up stays near.
STEP = 1 << 14


def _halved(column: np.ndarray, low: np.ndarray, bit: int) -> np.ndarray:
    """What is ``low`` in each node before what is not; all nodes but the last have ``1 << bit`` of either."""
    lows, highs, whole = column[low], column[~low], len(column) >> (bit + 1) << (bit + 1)
    half, out = whole >> 1, np.empty_like(column)
    nodes = out[:whole].reshape(-1, 2, 1 << bit)
    nodes[:, 0], nodes[:, 1] = lows[:half].reshape(-1, 1 << bit), highs[:half].reshape(-1, 1 << bit)
    out[whole:] = np.concatenate((lows[half:], highs[half:]))
    return out


class Prefixes:
    """The prefixes of ``y`` as sorted columns of which none is ever built.

    Ranks of values are halved level by level (a wavelet tree): at each level
    the ranks of a node stand together, in the order of ``y``, and ``zeros``
    counts how many before a place go to their node's lower half. Nodes are
    ranges of ranks, so a node starts at its least rank. With ``sums`` the
    lower half of each prefix is added up too.
    """

    def __init__(self, y: np.ndarray, sums: bool = False) -> None:
        n = len(y)
        by_value = np.argsort(y, kind="stable")
        self.n, self.sorted, self.levels = n, y[by_value], []
        self.ranks = ranks = np.empty(n, np.int32)
        ranks[by_value] = np.arange(n, dtype=np.int32)
        for bit in reversed(range(max(0, n - 1).bit_length())):
            low = (ranks & (1 << bit)) == 0
            zeros = np.zeros(n + 1, np.int32)
            np.cumsum(low, dtype=np.int32, out=zeros[1:])
            self.levels.append((bit, zeros))
            ranks = _halved(ranks, low, bit)
        self.lower = self._lower_halves() if sums else None

    def rank(self, size: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Rank in ``y`` of the ``k``-th value (from 0) of each prefix of ``size``, which is over ``k``."""
        start, inside, k = np.zeros(len(size), np.int64), size, k
        for bit, zeros in self.levels:
            low = zeros.take(start + inside) - (start >> 1)
            up = k >= low
            k, inside = k - low * up, np.where(up, inside - low, low)
            start = start + (up.astype(np.int64) << bit)
        return start

    def value(self, size: np.ndarray, k: np.ndarray) -> np.ndarray:
        return self.sorted.take(self.rank(size, k))

    def _every(self, run, first: float) -> np.ndarray:
        """``run`` of all sizes from 1 on, with ``first`` for the empty prefix ahead."""
        parts = [run(np.arange(lo, min(self.n + 1, lo + STEP))) for lo in range(1, self.n + 1, STEP)]
        return np.concatenate([[first], *parts])

    def _middle(self, size: np.ndarray) -> np.ndarray:
        return (self.value(size, (size - 1) // 2) + self.value(size, size // 2)) / 2

    @cached_property
    def middles(self) -> tuple[np.ndarray, np.ndarray]:
        """(n,) each: the ranks of the lower and the upper middle of each prefix, by its size from 1 on.

        Only even sizes are looked up: the middle of an odd one is its last value, held between the two before.
        """
        left, right = np.empty(self.n, np.int32), np.empty(self.n, np.int32)
        for lo in range(2, self.n + 1, 2 * STEP):
            size = np.arange(lo, min(self.n + 1, lo + 2 * STEP), 2)
            left[size - 1], right[size - 1] = self.rank(size, size // 2 - 1), self.rank(size, size // 2)
        new = self.ranks[2::2]
        left[:1] = right[:1] = self.ranks[:1]
        left[2::2] = right[2::2] = np.clip(new, left[1::2][: len(new)], right[1::2][: len(new)])
        return left, right

    def medians(self) -> np.ndarray:
        """(n + 1,): the median of each prefix by its size; NaN for the empty one."""
        left, right = self.middles
        return np.append(np.nan, (self.sorted.take(left) + self.sorted.take(right)) / 2)

    def absolute(self, y: np.ndarray) -> np.ndarray:
        """(n + 1,): sums of the distances to the median, of a column ``y`` that was given with ``sums``; 0 for the empty prefix."""
        return np.append(0.0, np.maximum(0, np.cumsum(y) - 2 * self.lower - self.medians()[1:] * (np.arange(1, self.n + 1) % 2)))

    def _lower_halves(self) -> np.ndarray:
        """(n,): sums of the values before the middle or the two middles' second, by size from 1 on; a value that comes changes the half by one value at most."""
        left, change = self.middles[0], np.zeros(self.n)
        new, before = self.ranks[1::2], left[::2]
        change[1::2] = self.sorted.take(np.minimum(new, before[: len(new)]))  # the half grows
        new, before = self.ranks[2::2], left[1::2][: len(self.ranks[2::2])]
        change[2::2] = np.where(new < before, self.sorted.take(new) - self.sorted.take(before), 0.0)  # it keeps its size
        return np.cumsum(change)

    def deviations(self) -> np.ndarray:
        """(n + 1,): the median distance to the median; 0 for the empty prefix."""
        return self._every(self._deviation, 0.0)

    def _deviation(self, size: np.ndarray) -> np.ndarray:
        m, k = self._middle(size), (size - 1) // 2
        i = self._window(size, m, k)
        # the k + 1 nearest values of a prefix stand together in it: from i or from i - 1
        right, left = self._right(size, i + k, m), self._left(size, i - 1, m)
        i = i - (left < right)
        nearest = np.minimum(left, right)
        after = np.minimum(self._right(size, i + k + 1, m), self._left(size, i - 1, m))
        return np.where(size % 2 == 1, nearest, (nearest + np.where(size % 2 == 1, 0.0, after)) / 2)

    def _right(self, size, at, m):
        """Distance of the value ``at`` over ``m``; infinite beyond the prefix."""
        return np.where(at < size, self.value(size, np.minimum(at, size - 1)) - m, np.inf)

    def _left(self, size, at, m):
        return np.where(at >= 0, m - self.value(size, np.maximum(at, 0)), np.inf)

    def _window(self, size: np.ndarray, m: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How many values of each prefix are farther under ``m`` than the one ``k`` places on is over it; the tree is searched for the last of these."""

        def farther(rank, before):
            return self._right(size, before + k, m) < m - self.sorted.take(np.minimum(rank, self.n - 1))

        start, inside, before = np.zeros(len(size), np.int64), size, np.zeros(len(size), np.int64)
        for bit, zeros in self.levels:
            low = zeros.take(start + inside) - (start >> 1)
            half = start + (1 << bit)
            up = (half < self.n) & farther(half, before + low)
            before, inside = before + low * up, np.where(up, inside - low, low)
            start = np.where(up, half, start)
        return before + inside * farther(start, before)
