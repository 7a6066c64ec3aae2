"""Growing forests: seeded draws, reductions, split search, level by level.

Only two things are done over all samples, once a level for all trees: nodes
count their samples, and each node that may split draws a bounded sample of its
in-bag rows. A node's rows have an order by hash; its first two thirds are in
the bag. Draws with replacement are ranks in the bag; since that order is
random, the rows that are drawn may be the first ones of it, so a node needs
its ``samples`` first rows only, and rows are passed over whose hash lies
beyond what that takes. The split search runs in NumPy over that draw.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..params import ForestParams
from .forest import Forest, Split
from .routing import Router, groups, matrix, weighed

#: Numbers of pairs of an input and a target that the split search holds at once, about (they should stay in a core's cache); bytes of draws that one task searches, about.
STEP_CELLS, SEARCH_BYTES = 1 << 18, 32 << 20


def generator(seed: int, *key: object) -> np.random.Generator:
    """A random generator that depends on seed and key only."""
    return np.random.default_rng(int.from_bytes(hashlib.md5("|".join(map(str, (seed, *key))).encode()).digest()[:8], "little"))


def uniform(ids: np.ndarray, seed: int, node: np.ndarray | int) -> np.ndarray:
    """A number in [0, 1) for each sample at its node, by hash."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(node).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed * 0x2545F4914F6CDD1D % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


# ---- dispersion of what is left when values are taken away one after the other


def removed_sme(ranked: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of absolute deviations from the median of what is left, before and after each removal.

    ``values`` (pairs, n) are sorted along each row; ``ranked`` (pairs, n) are
    the places in that order in which values go. Row p of the result (n + 1,
    pairs) is for the first p being gone. All pairs step together: a linked
    list keeps the order (with an end on both sides), a pointer the lower
    median, and ``apart`` is the sum above the pointer less that up to it.
    """
    pairs, n = values.shape
    width = n + 2
    base = np.arange(pairs, dtype=np.int64) * width
    value = np.zeros((pairs, width))
    value[:, 1:-1] = values
    value = value.ravel()
    after = np.tile(np.arange(1, width + 1, dtype=np.int32), pairs)
    before = np.tile(np.arange(-1, width - 1, dtype=np.int32), pairs)
    going = np.ascontiguousarray(ranked.T) + 1
    out = np.zeros((n + 1, pairs))
    middle = (n + 1) // 2
    at = np.full(pairs, middle, np.int64)
    apart = values[:, middle:].sum(1) - values[:, :middle].sum(1)
    for p in range(n):
        left = n - p
        here = base + at
        median = value.take(here)
        out[p] = apart + median if left % 2 else apart
        if left == 1:
            break
        gone = going[p]
        cell = base + gone
        lost, a, b = value.take(cell), before.take(cell), after.take(cell)
        after[base + a] = b
        before[base + b] = a
        below = gone <= at
        apart += np.where(below, lost, -lost)
        if left % 2:  # one more below than above: the pointer goes down unless one below it went
            apart += np.where(gone > at, 2 * median, 0.0)
            at = np.where(gone >= at, before.take(here), at)
        else:  # as many below as above: it goes up if one below it, or its own, went
            new = after.take(here)
            apart -= np.where(below, 2 * value.take(base + np.minimum(new, n)), 0.0)
            at = np.where(below, new, at)
    return out


def left_dispersion(order: np.ndarray, y: np.ndarray, kind: str) -> np.ndarray:
    """(n + 1, targets): dispersion of ``y`` once the first p rows of ``order`` are gone; 0 where none is left."""
    n, k = y.shape
    rest = y[order]
    if kind in ("ssme", "variance", "mad"):
        count = np.arange(n, -1, -1)[:, None]
        zero = np.zeros((1, k))
        s = np.concatenate((np.cumsum(rest[::-1], 0)[::-1], zero))
        q = np.concatenate((np.cumsum(rest[::-1] ** 2, 0)[::-1], zero))
        if kind == "variance":
            return np.where(count > 0, np.maximum(0, q / np.maximum(count, 1) - (s / np.maximum(count, 1)) ** 2), 0.0)
        middle = np.stack([np.median(rest[p:], 0) if p < n else np.zeros(k) for p in range(n + 1)])
        if kind == "ssme":
            return np.maximum(0, q - 2 * middle * s + count * middle**2)
        return np.stack([np.median(np.abs(rest[p:] - middle[p]), 0) if p < n else np.zeros(k) for p in range(n + 1)])
    if kind != "sme":
        raise ValueError("dispersion is sme, ssme, variance or mad")
    by_value = np.argsort(y, 0, kind="stable")
    rank = np.empty_like(by_value)
    np.put_along_axis(rank, by_value, np.arange(n)[:, None], 0)
    return removed_sme(rank[order].T.astype(np.int32), np.sort(y, 0).T)


def split_scores(x: np.ndarray, y: np.ndarray, norm: int, balance: float, kind: str = "sme") -> tuple[np.ndarray, np.ndarray]:
    """(inputs, n) scores of cutting after each row of each input's order, and these orders.

    The row that is the cut is in neither side. A side's dispersions, to the
    power ``norm``, are added over targets and weighed by its share to the
    power ``balance``.
    """
    n, inputs = x.shape
    p = np.arange(n)
    up, down = ((n - p) / n) ** balance, ((p + 1) / n) ** balance
    if kind == "sme":
        right, left, orders = (m[0] for m in _sme_sides(x[None], y[None], norm))
    else:
        orders = np.argsort(x, 0, kind="stable").T
        right, left = (np.stack([(left_dispersion(o, y, kind) ** norm).sum(1) for o in way]) for way in (orders, orders[:, ::-1]))
    # right of p: the first p + 1 gone; left of p: of the other way round the first n - p gone
    return right[:, 1:] * up + left[:, 1:][:, ::-1] * down, orders


def _sme_sides(x: np.ndarray, y: np.ndarray, norm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For draws ``x`` (nodes, n, inputs) and ``y`` (nodes, n, targets): dispersions of what is left, taken away in each input's order and the other way round, both (nodes, inputs, n + 1), and the orders.

    All pairs of all nodes step together, as many as a step takes.
    """
    nodes, n, inputs = x.shape
    targets = y.shape[2]
    orders = np.argsort(x, 1, kind="stable").transpose(0, 2, 1)
    rank = np.empty(y.shape, np.int32)
    np.put_along_axis(rank, np.argsort(y, 1, kind="stable"), np.arange(n, dtype=np.int32)[None, :, None], 1)
    values = np.sort(y, 1).transpose(0, 2, 1)
    out = np.empty((2, nodes * inputs, n + 1))
    flat = orders.reshape(-1, n)
    of = np.repeat(np.arange(nodes), inputs)
    step = max(1, STEP_CELLS // max(1, 2 * targets * n))
    for lo in range(0, nodes * inputs, step):
        some, node = flat[lo : lo + step], of[lo : lo + step]
        both = np.concatenate((some, some[:, ::-1]))
        node2 = np.concatenate((node, node))
        ranked = rank[node2[:, None], both].transpose(0, 2, 1).reshape(-1, n)
        d = removed_sme(ranked, values[node2].reshape(-1, n)).reshape(n + 1, 2, len(some), targets)
        out[:, lo : lo + step] = (d**norm).sum(3).transpose(1, 2, 0)
    right, left = out.reshape(2, nodes, inputs, n + 1)
    return right, left, orders


def _least(scores: np.ndarray, orders: np.ndarray, guard: int) -> tuple[int, int, float] | None:
    """(input, row, score) of the least score with ``guard`` rows or more on both sides; the first one on ties."""
    n = scores.shape[1]
    if n < 2 * guard + 1:
        return None
    fine = scores[:, guard : n - guard + 1] if guard else scores
    if not np.isfinite(fine).any():
        return None
    i, p = divmod(int(np.nanargmin(fine)), fine.shape[1])
    return i, int(orders[i, p + guard]), float(scores[i, p + guard])


def best_splits(draws_: list[tuple[np.ndarray, np.ndarray]], norm: int, balance: float, kind: str = "sme", guard: int = 2) -> list[tuple[int, int, float, float] | None]:
    """(input, row, score, gain) of the best split of each draw ``(x, y)``; draws of one shape are searched together."""
    out: list[tuple[int, int, float, float] | None] = [None] * len(draws_)
    shapes: dict[tuple, list[int]] = {}
    for i, (x, y) in enumerate(draws_):
        shapes.setdefault((x.shape, y.shape), []).append(i)
    for ((n, inputs), (_, targets)), which in shapes.items():
        step = max(1, STEP_CELLS // max(1, 2 * inputs * targets * n)) if kind == "sme" else 1
        p = np.arange(n)
        up, down = ((n - p) / n) ** balance, ((p + 1) / n) ** balance
        for lo in range(0, len(which), step):
            some = which[lo : lo + step]
            if kind == "sme":
                right, left, orders = _sme_sides(np.stack([draws_[i][0] for i in some]), np.stack([draws_[i][1] for i in some]), norm)
                scores, whole = right[:, :, 1:] * up + left[:, :, 1:][:, :, ::-1] * down, right[:, 0, 0]
            else:
                one, order = split_scores(*draws_[some[0]], norm, balance, kind)
                scores, orders = one[None], order[None]
                whole = [(left_dispersion(order[0], draws_[some[0]][1], kind)[0] ** norm).sum()]
            for k, i in enumerate(some):
                found = _least(scores[k], orders[k], guard)
                out[i] = None if found is None else (*found, float(whole[k]) - found[2])
    return out


def best_split(x: np.ndarray, y: np.ndarray, norm: int, balance: float, kind: str = "sme", guard: int = 2) -> tuple[int, int, float, float] | None:
    """(input, row, score, gain) of the least score with ``guard`` rows or more on both sides; the first one on ties."""
    return best_splits([(x, y)], norm, balance, kind, guard)[0]


# ---- component reduction


def components(x: np.ndarray, most: int, row_sum_scaling: bool = False, rounds: int = 10_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores of features, loadings of rows, means) of up to ``most`` principal components, one after the other.

    Columns are centred; a component is found by alternating between loadings
    and scores of length 1 until the length settles, then taken out. A matrix
    without variance left gives fewer.
    """
    mean = x.mean(0)
    rest = x - mean
    if row_sum_scaling:
        total = x.sum(1)
        rest = np.divide(rest, total[:, None], out=np.zeros_like(rest), where=total[:, None] != 0)
    scores, loadings = [], []
    for _ in range(most):
        load = rest[:, int(np.argmax((rest**2).sum(0)))].copy()
        length = 0.0
        for _ in range(rounds):
            score = rest.T @ load
            now = float(np.linalg.norm(score))
            if now < 1e-12:
                break
            score /= now
            load = rest @ score
            if abs(now - length) < 1e-3 * max(1e-9, min(1.0, now)):
                break
            length = now
        else:
            break
        if now < 1e-12:
            break
        scores.append(score)
        loadings.append(load)
        rest = rest - np.outer(load, score)
    return np.array(scores).reshape(-1, x.shape[1]), np.array(loadings).reshape(-1, len(x)).T, mean


# ---- one node


def draws(seed: int, tree: int, node: int, n: int, params: ForestParams, inputs: int, outputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks in the bag of the rows drawn, input features and target features, all with replacement."""
    rng = generator(seed, tree, node)
    bag = int(params.bag * n)
    rows = rng.integers(0, bag, params.samples) if bag else np.zeros(0, np.int64)
    return rows, rng.integers(0, inputs, params.in_features), rng.integers(0, outputs, params.out_features)


def first_rows(n: int, params: ForestParams) -> float:
    """Hash under which a node's rows are sent: enough for its draw but for a chance of 1e-9."""
    need = min(params.samples, int(params.bag * n))
    return min(1.0, (need + 6 * math.sqrt(need) + 20) / max(1, n))


def prepared(ids, hashes, x, y, tree: int, node: int, n: int, params: ForestParams, root: bool, inputs: int, outputs: int) -> tuple[list, list, list, np.ndarray, np.ndarray] | None:
    """(features, scores, means) of each candidate test of a node, its values on the draw, and the targets; none if it can't split.

    ``x`` and ``y`` hold the drawn features only, of the rows sent.
    """
    ranks, ins, outs = draws(params.seed, tree, node, n, params, inputs, outputs)
    if int(params.bag * n) < params.least_side:
        return None
    order = np.lexsort((ids, hashes))
    _, back = np.unique(ranks, return_inverse=True)
    row = order[np.minimum(back, len(order) - 1)]
    x, y = x[row], y[row]
    if params.exclude_self:
        fine = ~np.isin(outs, ins)
        y = y[:, fine] if fine.any() else y
    features, scores, means = [[int(f)] for f in ins], [[1.0]] * len(ins), [[0.0]] * len(ins)
    values = x
    if params.reduce_input and not root:
        few, seen = np.unique(ins, return_index=True)
        s, _, mean = components(x[:, seen], 1, params.row_sum_scaling)
        if not len(s):
            return None
        features, scores, means = [few.tolist()], [s[0].tolist()], [mean.tolist()]
        values = weighed(x[:, seen], s[0], mean, params.row_sum_scaling)[:, None]  # the score by which samples are routed
    if params.reduce_output or root:
        _, y, _ = components(y, params.braids, params.row_sum_scaling)
    if not y.shape[1] or not np.ptp(values, axis=0).any():
        return None
    return features, scores, means, values, y


def node_splits(nodes: list[tuple], params: ForestParams) -> list[tuple[list[int], list[float], list[float], float, float] | None]:
    """(features, scores, means, threshold, gain) of the split of each of some ``prepared`` nodes, or none."""
    ready = [i for i, p in enumerate(nodes) if p is not None]
    found = best_splits([nodes[i][3:] for i in ready], params.norm, params.balance, params.dispersion, params.guard)
    out: list = [None] * len(nodes)
    for i, got in zip(ready, found, strict=True):
        if got is not None:
            features, scores, means, values, _ = nodes[i]
            k, row, _, gain = got
            out[i] = features[k], scores[k], means[k], float(values[row, k]), gain
    return out


# ---- all nodes of a level


_SENT = "node long, tree int, n long, sample_id long, hash double, x array<double>, y array<double>"
_FOUND = "node long, features array<int>, scores array<double>, means array<double>, split double, gain double"


def _send(held, seed: int):
    """Of each node that may split the first rows of its order, with the features that it has drawn."""
    schema = pa.schema([("node", pa.int64()), ("tree", pa.int32()), ("n", pa.int64()), ("sample_id", pa.int64()), ("hash", pa.float64()), ("x", pa.list_(pa.float64())), ("y", pa.list_(pa.float64()))])

    def run(batches):
        state, (nodes, trees, sizes, under, ins, outs) = held.value
        router = Router.of(state)
        for batch in batches:
            ids, x, y = batch.column(0).to_numpy(), matrix(batch.column(1)), matrix(batch.column(2))
            leaves = router.leaves(x)
            for t in range(leaves.shape[1]):
                at = np.minimum(np.searchsorted(nodes, leaves[:, t]), max(0, len(nodes) - 1))
                rows = np.flatnonzero(nodes[at] == leaves[:, t]) if len(nodes) else np.zeros(0, np.int64)
                h = uniform(ids[rows], seed, leaves[rows, t])
                near = h < under[at[rows]]
                rows, h = rows[near], h[near]
                at = at[rows]
                if len(rows):
                    values = (x[rows[:, None], ins[at]], y[rows[:, None], outs[at]])
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel())) for m in values]
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(trees[at]), pa.array(sizes[at]), pa.array(ids[rows]), pa.array(h), *lists], schema=schema)

    return run


def _search(params: ForestParams, first: int, inputs: int, outputs: int):
    def run(table: pa.Table) -> pa.Table:
        node, tree, n, ids, hashes = (table[c].to_numpy() for c in ("node", "tree", "n", "sample_id", "hash"))
        x, y = (matrix(table[c].combine_chunks()) for c in ("x", "y"))
        order = np.argsort(node, kind="stable")
        cuts = np.flatnonzero(np.diff(node[order], prepend=-1))
        parts = np.split(order, cuts[1:])
        ready = [prepared(ids[r], hashes[r], x[r], y[r], int(tree[r[0]]), int(node[r[0]]), int(n[r[0]]), params, int(node[r[0]]) < first, inputs, outputs) for r in parts]
        rows = [(int(node[r[0]]), *got) for r, got in zip(parts, node_splits(ready, params), strict=True) if got is not None]
        kinds = pa.schema([("node", pa.int64()), ("features", pa.list_(pa.int32())), ("scores", pa.list_(pa.float64())), ("means", pa.list_(pa.float64())), ("split", pa.float64()), ("gain", pa.float64())])
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

    return run


class _Growing:
    """Trees while they grow: nodes are numbered as they come, roots first."""

    def __init__(self, trees: int) -> None:
        self.tree = list(range(trees))
        self.kids: dict[int, tuple[int, int]] = {}
        self.test: dict[int, tuple] = {}
        self.trees = trees

    def split(self, node: int, test: tuple) -> tuple[int, int]:
        left = len(self.tree)
        self.tree += [self.tree[node]] * 2
        self.kids[node], self.test[node] = (left, left + 1), test
        return left, left + 1

    def undo(self, node: int) -> None:
        del self.kids[node], self.test[node]

    def below(self, root: int) -> list[tuple]:
        out, stack = [], [root]
        while stack:
            n = stack.pop()
            left, right = self.kids.get(n, (None, None))
            features, scores, means, split = self.test.get(n, ((), (), (), 0.0))
            out.append((n, left, right, features, scores, means, split))
            stack += [] if left is None else [left, right]
        return out

    def routers(self, scaling: bool) -> list[Router]:
        rows = [self.below(t) for t in range(self.trees)]
        return [Router([n for t in some for n in rows[t]], some, scaling) for some in groups(rows)]

    def grown(self, node: int) -> Split:
        if node not in self.kids:
            return Split()
        features, scores, means, split = self.test[node]
        left, right = self.kids[node]
        return Split(tuple(features), tuple(scores), tuple(means), split, self.grown(left), self.grown(right))


def grow(samples: DataFrame, params: ForestParams, targets: DataFrame | None = None) -> Forest:
    """A forest grown over ``samples(sample_id, x)`` for ``targets(sample_id, y)``, or for ``x`` itself.

    Samples and targets have equal rows, not equal columns. Roots always reduce
    their targets; other nodes follow ``params``. A split that leaves fewer
    than ``least_side`` samples on a side is undone and its node stays a leaf.
    With ``max_splits`` only so many splits of the largest gain are kept in
    each tree, best first. An empty table gives trees of a root only; a null or
    non-finite value is an error. Reruns with one seed give the same forest.
    """
    spark: SparkSession = samples.sparkSession
    data = samples.select("sample_id", F.col("x").cast("array<double>").alias("x"))
    data = data.withColumn("y", F.col("x")) if targets is None else data.join(targets.select("sample_id", F.col("y").cast("array<double>").alias("y")), "sample_id")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    shape = data.agg(F.count(F.lit(1)), F.max(F.size("x")), F.min(F.size("x")), F.max(F.size("y")), F.max((F.exists("x", bad) | F.exists("y", bad)).cast("int"))).first()
    n, inputs, least, outputs, wrong = shape
    if wrong or (n and least != inputs):
        raise ValueError("vectors must have one length and finite numbers only")
    if not n:
        return Forest(spark, [Split() for _ in range(params.trees)], params.row_sum_scaling)
    spread = data.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    if spread:  # a small matrix in a few files: dealt out once, for every level reads it twice
        data = data.repartition(spark.sparkContext.defaultParallelism, "sample_id").persist()
    growing, gains = _Growing(params.trees), {}
    open_ = {t: n for t in range(params.trees)} if params.depth > 0 else {}
    for depth in range(params.depth):
        open_ = {node: k for node, k in open_.items() if k >= 2 * params.least_side}
        if not open_:
            break
        plan = {node: (growing.tree[node], k, first_rows(k, params), *draws(params.seed, growing.tree[node], node, k, params, inputs, outputs)[1:]) for node, k in open_.items()}
        sent = None
        for router in growing.routers(params.row_sum_scaling):
            own = sorted(set(router.ids.tolist()) & set(plan))
            columns = [[plan[k][i] for k in own] for i in range(5)]
            table = (np.array(own, np.int64), np.array(columns[0], np.int32), np.array(columns[1], np.int64), np.array(columns[2], float), np.array(columns[3], np.int32).reshape(len(own), -1), np.array(columns[4], np.int32).reshape(len(own), -1))
            held = spark.sparkContext.broadcast((router.__dict__, table))
            part = data.mapInArrow(_send(held, params.seed), _SENT)
            sent = part if sent is None else sent.unionByName(part)
        size = sum(min(1.0, p[2]) * p[1] for p in plan.values()) * (params.in_features + params.out_features) * 8
        lots = max(1, min(len(plan), max(int(size // SEARCH_BYTES), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
        found = sent.groupBy(F.pmod("node", F.lit(lots))).applyInArrow(_search(params, params.trees, inputs, outputs), _FOUND).collect()  # a row for each node of the level
        tried = []
        for r in sorted(found, key=lambda r: r.node):
            gains[r.node] = r.gain
            tried.append((r.node, growing.split(r.node, (r.features, r.scores, r.means, r.split))))
        if not tried:
            break
        counts: dict[int, int] = {}
        for router in growing.routers(params.row_sum_scaling):
            held = spark.sparkContext.broadcast(router.__dict__)
            for r in data.select("sample_id", "x").mapInArrow(_count(held), "leaf_id long, n long").groupBy("leaf_id").agg(F.sum("n").alias("n")).collect():
                counts[r.leaf_id] = r.n
        open_ = {}
        for node, (left, right) in tried:
            if min(counts.get(left, 0), counts.get(right, 0)) < params.least_side:
                growing.undo(node)
            elif depth + 1 < params.depth:
                open_ |= {left: counts[left], right: counts[right]}
    if spread:
        data.unpersist()
    if params.max_splits:
        for t in range(params.trees):
            _keep_best(growing, t, gains, params.max_splits)
    return Forest(spark, [growing.grown(t) for t in range(params.trees)], params.row_sum_scaling)


def _count(held):
    def run(batches):
        totals: dict[int, int] = {}
        router = Router.of(held.value)
        for batch in batches:
            ids, k = np.unique(router.leaves(matrix(batch.column(1))), return_counts=True)
            for i, c in zip(ids.tolist(), k.tolist(), strict=True):
                totals[i] = totals.get(i, 0) + c
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], names=["leaf_id", "n"])

    return run


def _keep_best(growing: _Growing, root: int, gains: dict[int, float], most: int) -> None:
    """Of one tree the ``most`` splits that best-first growth would have made."""
    import heapq

    heap = [(-gains[root], root)] if root in growing.kids else []
    kept = set()
    while heap and len(kept) < most:
        _, node = heapq.heappop(heap)
        kept.add(node)
        for kid in growing.kids[node]:
            if kid in growing.kids:
                heapq.heappush(heap, (-gains[kid], kid))
    for node, *_ in growing.below(root):
        if node in growing.kids and node not in kept:
            growing.undo(node)
