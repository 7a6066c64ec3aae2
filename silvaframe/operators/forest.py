"""A forest as relations: nodes, closure, members, traversal, statistics, prediction."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .routing import Router, groups, matrix

NODE = "node_id long, tree_id int, parent_id long, sister_id long, level int, lr int, is_leaf boolean, features array<int>, scores array<double>, means array<double>, split double"
#: Nodes up to which routing is one column expression, inside generated code.
COMPILED = 128
#: Bytes of per-leaf vectors that are broadcast at most; larger tables are joined.
TABLE_BYTES = 64 << 20


@dataclass
class Split:
    """A node of a tree under construction: a reduction with threshold and two children, or a leaf."""

    features: tuple[int, ...] = ()
    scores: tuple[float, ...] = ()
    means: tuple[float, ...] = ()
    split: float = 0.0
    left: Split | None = None
    right: Split | None = None

    def column(self, x: Column, number: dict[int, int]) -> Column:
        """The leaf that ``x`` reaches, as one expression; equal scores go left."""
        if self.left is None:
            return F.lit(number[id(self)]).cast("long")
        score = sum(((F.element_at(x, f + 1) - m) * s for f, s, m in zip(self.features, self.scores, self.means, strict=True)), F.lit(0.0))
        return F.when(score <= self.split, self.left.column(x, number)).otherwise(self.right.column(x, number))

    def walk(self):
        """This node and all below it, children before their parent."""
        if self.left is not None:
            yield from self.left.walk()
            yield from self.right.walk()
        yield self


def rows_of(trees: list[Split]) -> tuple[list[tuple], list[dict[int, int]]]:
    """Node rows of all trees, children before their parent, root last; and the number of each split."""
    rows, numbers, base = [], [], 0
    for t, tree in enumerate(trees):
        order: list[tuple[Split, Split | None, int, int]] = []

        def below(node, level):
            kids = [] if node.left is None else [node.left, node.right]
            for kid in kids:
                below(kid, level + 1)
            order.extend((kid, node, level + 1, side) for side, kid in enumerate(kids))

        below(tree, 0)
        order.append((tree, None, 0, 0))
        number = {id(n): base + i for i, (n, _, _, _) in enumerate(order)}
        for node, parent, level, side in order:
            sister = None if parent is None else number[id(parent.right if side == 0 else parent.left)]
            up = parent or Split()
            rows.append((number[id(node)], t, None if parent is None else number[id(parent)], sister, level, side, node.left is None, list(up.features), list(up.scores), list(up.means), up.split))
        base += len(order)
        numbers.append(number)
    return rows, numbers


def _route(held):
    def run(batches):
        router = Router.of(held.value)
        for batch in batches:
            leaves = router.leaves(matrix(batch.column(1)))
            ids = np.repeat(np.arange(batch.num_rows), leaves.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(leaves.ravel())], names=["sample_id", "leaf_id"])

    return run


def scored(held, width: int, trees: int = 0):
    """Vectors of the leaves that rows reach, added up over trees: over those with one, or over ``trees`` if that is given."""

    def run(batches):
        states, ids, vectors = held.value
        routers = [Router.of(s) for s in states]
        for batch in batches:
            x = matrix(batch.column(1))
            total, hits = np.zeros((len(x), width)), np.zeros(len(x))
            for router in routers:
                leaves = router.leaves(x)
                for t in range(leaves.shape[1]):
                    at = np.minimum(np.searchsorted(ids, leaves[:, t]), max(0, len(ids) - 1))
                    known = ids[at] == leaves[:, t] if len(ids) else np.zeros(len(x), bool)
                    total[known] += vectors[at[known]]
                    hits += known
            out = total / (trees or np.maximum(hits, 1)[:, None])
            bounds = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(bounds, pa.array(out.ravel()))], names=["sample_id", "predicted"])

    return run


_SUMS = pa.schema([("leaf_id", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.float64())), ("squares", pa.list_(pa.float64()))])


def _flush(totals):
    """Batches of (leaf, rows, sums, sums of squares) from a dict of matrices."""
    ids = sorted(totals)
    for lo in range(0, len(ids), 64):
        some = ids[lo : lo + 64]
        lists = [pa.array([totals[i][k] for i in some], pa.list_(pa.float64())) for k in (1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([totals[i][0] for i in some], pa.int64()), *lists], schema=_SUMS)


#: Numbers that a task holds of its leaves' sums before it sends them on.
HELD_SUMS = 8_000_000


def _leaf_sums(held):
    """Count, sum and sum of squares of whole vectors, for each leaf that a task's samples reach."""

    def run(batches):
        router, totals = Router.of(held.value), {}
        for batch in batches:
            x = matrix(batch.column(1))
            leaves = router.leaves(x)
            x = matrix(batch.column(2)) if batch.num_columns > 2 else x
            for t in range(leaves.shape[1]):
                order = np.argsort(leaves[:, t], kind="stable")
                ids, first = np.unique(leaves[order, t], return_index=True)
                sums, squares = np.add.reduceat(x[order], first), np.add.reduceat(x[order] ** 2, first)
                for i, n, s, q in zip(ids.tolist(), np.diff(np.append(first, len(x))).tolist(), sums, squares, strict=True):
                    old = totals.get(i)
                    totals[i] = (n, s, q) if old is None else (old[0] + n, old[1] + s, old[2] + q)
            if len(totals) * 2 * x.shape[1] > HELD_SUMS:
                yield from _flush(totals)
                totals = {}
        yield from _flush(totals)

    return run


class Forest:
    """Trees with their relations; every method returns a lazy DataFrame.

    Node rows are metadata, a few per tree, and bounded by the forest; samples
    are only ever read, never held. ``samples`` have ``sample_id`` and ``x``,
    vectors of one length.
    """

    def __init__(self, spark: SparkSession, trees: list[Split], row_sum_scaling: bool = False) -> None:
        self.spark, self.trees, self.row_sum_scaling = spark, trees, row_sum_scaling
        self.rows, self.numbers = rows_of(trees)
        self.nodes = spark.createDataFrame(self.rows, NODE)
        self.parent = {r[0]: r[2] for r in self.rows}
        closure = []
        for n in self.parent:
            up, distance = n, 0
            while up is not None:
                closure.append((n, up, distance))
                up, distance = self.parent[up], distance + 1
        self.closure = closure
        self.path = spark.createDataFrame(closure, "node_id long, ancestor_id long, distance int")

    def routers(self) -> list[Router]:
        """Node arrays, in groups of trees that are small enough to broadcast."""
        rows = []
        for tree, number in zip(self.trees, self.numbers, strict=True):
            own = []
            for s in tree.walk():
                kids = (None, None) if s.left is None else (number[id(s.left)], number[id(s.right)])
                own.append((number[id(s)], *kids, s.features, s.scores, s.means, s.split))
            rows.append(own)
        out = []
        for some in groups(rows):
            out.append(Router([n for t in some for n in rows[t]], [self.numbers[t][id(self.trees[t])] for t in some], self.row_sum_scaling))
        return out

    def _passes(self, samples: DataFrame, run, schema: str) -> DataFrame:
        out = None
        vectors = [F.col(c).cast("array<double>").alias(c) for c in ("x", "y") if c in samples.columns]
        for router in self.routers():
            held = self.spark.sparkContext.broadcast(router.__dict__)
            part = samples.select("sample_id", *vectors).mapInArrow(run(held), schema)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def leaves_of(self, samples: DataFrame) -> DataFrame:
        """``(sample_id, leaf_id)``: one leaf a tree, in one pass for as many trees as may be broadcast, no shuffle.

        A small forest is one column expression; a larger one goes through
        NumPy, since generated code has a bound.
        """
        if len(self.rows) <= COMPILED and not self.row_sum_scaling:
            reached = [t.column(F.col("x"), n) for t, n in zip(self.trees, self.numbers, strict=True)]
            return samples.select("sample_id", F.explode(F.array(*reached)).alias("leaf_id"))
        return self._passes(samples, _route, "sample_id long, leaf_id long")

    def members(self, samples: DataFrame) -> DataFrame:
        """``(node_id, sample_id)`` for every node on each sample's ways down.

        Leaves are routed, ancestors come from the closure, which has at most
        depth + 1 rows a node and so stays small however many samples there are.
        """
        return self.leaves_of(samples).join(self._small(self._up(), len(self.closure) * 24), "leaf_id").select("node_id", "sample_id")

    def _up(self) -> DataFrame:
        return self.path.select(F.col("node_id").alias("leaf_id"), F.col("ancestor_id").alias("node_id"))

    @staticmethod
    def _small(table: DataFrame, size: int) -> DataFrame:
        """``table`` marked for broadcast if its ``size`` in bytes is known to be small."""
        return F.broadcast(table) if size <= TABLE_BYTES else table

    def node_sums(self, samples: DataFrame) -> DataFrame:
        """``(node_id, feature_id, n, s, q)``: rows, sum and sum of squares of ``x``, or of ``y`` if samples have one.

        One pass over whole vectors: each task adds up the vectors of each
        leaf, so a leaf is sent once by a task; nodes are the sums of their
        leaves. Nodes without samples are left out.
        """
        parts = self._passes(samples, _leaf_sums, "leaf_id long, n long, sums array<double>, squares array<double>")
        up = parts.join(self._small(self._up(), len(self.closure) * 24), "leaf_id").select("node_id", "n", F.posexplode(F.arrays_zip("sums", "squares")).alias("f", "v"))
        cells = up.groupBy("node_id", "f").agg(F.sum("n").alias("n"), F.sum("v.sums").alias("s"), F.sum("v.squares").alias("q"))
        return cells.select("node_id", F.col("f").alias("feature_id"), "n", "s", "q")

    def node_features_of(self, samples: DataFrame, targets: DataFrame) -> DataFrame:
        """``node_features`` of ``targets(sample_id, y)`` for samples routed by their ``x``."""
        return self.node_features(samples.select("sample_id", "x").join(targets.select("sample_id", "y"), "sample_id"))

    def node_features(self, samples: DataFrame) -> DataFrame:
        """``(node_id, feature_id, n, mean, sse, parent_mean, parent_sse)``: errors about the node's and its parent's mean.

        A root has no parent: its errors there are about 0.
        """
        own = self.node_sums(samples)
        nodes = self.nodes.select("node_id", "parent_id")
        up = own.select(F.col("node_id").alias("parent_id"), "feature_id", (F.col("s") / F.col("n")).alias("parent_mean"))
        out = own.join(self._small(nodes, len(self.rows) * 16), "node_id").join(up, ["parent_id", "feature_id"], "left")
        mean, other = F.col("s") / F.col("n"), F.coalesce("parent_mean", F.lit(0.0))
        return out.select("node_id", "feature_id", "n", mean.alias("mean"), F.greatest(F.lit(0.0), F.col("q") - F.col("s") * mean).alias("sse"), "parent_mean", F.greatest(F.lit(0.0), F.col("q") - 2 * other * F.col("s") + F.col("n") * other * other).alias("parent_sse"))

    def by_leaves(self, samples: DataFrame, ids: np.ndarray, vectors: np.ndarray, over_all: bool = False) -> DataFrame:
        """``(sample_id, predicted)``: ``vectors`` of the leaves ``ids`` (sorted) that samples reach, averaged over trees; one pass, no shuffle.

        Vectors are broadcast, so the caller has checked their size. With
        ``over_all`` leaves that aren't among ``ids`` count as zeros.
        """
        width = vectors.shape[1]
        held = self.spark.sparkContext.broadcast(([r.__dict__ for r in self.routers()], ids, vectors))
        rows = samples.select("sample_id", F.col("x").cast("array<double>").alias("x"))
        return rows.mapInArrow(scored(held, width, len(self.trees) if over_all else 0), "sample_id long, predicted array<double>")

    def fits(self, width: int) -> bool:
        """Whether vectors of ``width`` numbers for all nodes are small enough to broadcast."""
        return len(self.rows) * width * 8 <= TABLE_BYTES

    def predict(self, samples: DataFrame, leaf_means: DataFrame, width: int) -> DataFrame:
        """``(sample_id, predicted)``: leaf means averaged over the trees in whose leaf there is one; zeros if none.

        ``leaf_means(node_id, means)`` are vectors of ``width`` numbers; they
        are broadcast if forest and width keep them small, else joined.
        """
        if self.fits(width):
            got = sorted((r.node_id, r.means) for r in leaf_means.collect())
            return self.by_leaves(samples, np.array([i for i, _ in got], np.int64), np.array([m for _, m in got], float).reshape(len(got), width))
        means = leaf_means.withColumnRenamed("node_id", "leaf_id")
        hit = self.leaves_of(samples).join(means, "leaf_id", "left").select("sample_id", F.posexplode_outer("means").alias("f", "m"))
        flat = hit.groupBy("sample_id", "f").agg(F.avg("m").alias("m"))
        rows = flat.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("f").isNotNull(), F.struct("f", "m")))).alias("got"))
        every = F.sequence(F.lit(0), F.lit(width - 1))
        return rows.select("sample_id", F.transform(every, lambda f: F.coalesce(F.try_element_at("got", f), F.lit(0.0))).alias("predicted"))


def fixture(spark: SparkSession) -> Forest:
    """Three trees of seven nodes over dimensions 0-8 with thresholds of 0."""

    def on(f, left=None, right=None):
        return Split((f,), (1.0,), (0.0,), 0.0, left or Split(), right or Split())

    return Forest(spark, [on(t, on(4 + 2 * t), on(5 + 2 * t)) for t in range(3)])
