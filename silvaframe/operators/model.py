"""Fit, predict, report, store and restore: a forest with the matrix that it was grown on."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..params import ForestParams
from .forest import Forest, Split
from .training import grow

MODES = ("additive_mean", "mean")


class Prediction:
    """What a model says of ``samples(sample_id, x)``; lazy throughout."""

    def __init__(self, model: ForestModel, samples: DataFrame) -> None:
        self.model, self.samples = model, samples

    def predicted(self, mode: str = "additive_mean") -> DataFrame:
        """``(sample_id, predicted)``, a vector over targets.

        ``mean`` averages the means of the leaves that a sample reaches (leaves
        without training samples don't count; 0 if there is none left).
        ``additive_mean`` adds each node's gain over its parent, over the
        number of trees. Where each sample reaches one leaf with samples a tree, both are the same.
        """
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        m = self.model
        if mode == "mean":
            return m.forest.predict(self.samples, m.forest_leaf_means(), m.width)
        if m.forest.fits(m.width):
            return m.forest.by_leaves(self.samples, *m.leaf_gains(), over_all=True)
        members = m.forest.members(self.samples)
        gains = m.node_features().select("node_id", "feature_id", (F.col("mean") - F.coalesce("parent_mean", F.lit(0.0))).alias("gain"))
        gains = gains.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature_id", "gain"))), lambda g: g["gain"]).alias("gains"))
        hit = members.join(Forest._small(gains, len(m.forest.rows) * m.width * 8), "node_id").select("sample_id", F.posexplode("gains").alias("f", "g"))
        summed = hit.groupBy("sample_id", "f").agg((F.sum("g") / len(m.forest.trees)).alias("p"))
        return summed.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "p"))), lambda v: v["p"]).alias("predicted"))

    def residuals(self, truth: DataFrame | None = None, mode: str = "additive_mean") -> DataFrame:
        """``(sample_id, feature_id, value, residual, null_residual)`` against ``truth(sample_id, y)``, or the samples themselves."""
        truth = self.samples.select("sample_id", F.col("x").cast("array<double>").alias("y")) if truth is None else truth.select("sample_id", F.col("y").cast("array<double>").alias("y"))
        width = self.model.width
        centre = truth.agg(F.array(*[F.avg(F.get("y", F.lit(i))) for i in range(width)]).alias("centre")) if width <= 64 else truth.select(F.posexplode("y").alias("f", "v")).groupBy("f").agg(F.avg("v").alias("v")).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "v"))), lambda v: v["v"]).alias("centre"))
        both = truth.join(self.predicted(mode), "sample_id").crossJoin(F.broadcast(centre))  # one row of centres
        return both.select("sample_id", F.posexplode(F.arrays_zip("y", "predicted", "centre")).alias("feature_id", "v")).select("sample_id", "feature_id", F.col("v.y").alias("value"), (F.col("v.y") - F.col("v.predicted")).alias("residual"), (F.col("v.y") - F.col("v.centre")).alias("null_residual"))

    def report(self, truth: DataFrame | None = None, mode: str = "additive_mean") -> dict[str, DataFrame]:
        """Unexplained variance: ``total``, and by ``feature`` and ``sample`` with one added above and below."""
        r = self.residuals(truth, mode)
        sse, sst = F.sum(F.col("residual") ** 2), F.sum(F.col("null_residual") ** 2)
        return {"total": r.agg((sse / sst).alias("fvu")), **{k: r.groupBy(c).agg(((sse + 1) / (sst + 1)).alias("fvu")) for k, c in (("feature", "feature_id"), ("sample", "sample_id"))}}


class ForestModel:
    """A forest, the samples and targets it was grown on, and names of the target features."""

    def __init__(self, forest: Forest, samples: DataFrame, targets: DataFrame | None = None, params: ForestParams | None = None, names: list[str] | None = None) -> None:
        self.forest, self.samples, self.targets, self.params = forest, samples, targets, params or ForestParams()
        y = samples.select("x") if targets is None else targets.select(F.col("y").alias("x"))
        self.width = int(y.agg(F.max(F.size("x"))).first()[0] or 0)
        self.names = names or [str(i) for i in range(self.width)]
        self._features: DataFrame | None = None

    @classmethod
    def fit(cls, samples: DataFrame, params: ForestParams | None = None, targets: DataFrame | None = None, names: list[str] | None = None) -> ForestModel:
        """Grow a forest; without ``params`` their sizes follow the matrix."""
        if params is None:
            n, width = samples.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
            params = ForestParams().auto(n, width or 1)
        return cls(grow(samples, params, targets), samples, targets, params, names)

    def node_features(self) -> DataFrame:
        """Statistics of each node over its training samples' targets, kept for this session's reuse."""
        if self._features is None:
            if self.targets is None:
                self._features = self.forest.node_features(self.samples).persist()
            else:
                self._features = self.forest.node_features_of(self.samples, self.targets).persist()
        return self._features

    def unpersist(self) -> None:
        if self._features is not None:
            self._features.unpersist()
            self._features = None

    def forest_leaf_means(self) -> DataFrame:
        leaf = self.forest.nodes.where("is_leaf").select("node_id")
        cells = self.node_features().join(Forest._small(leaf, len(self.forest.rows) * 8), "node_id", "left_semi")
        return cells.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature_id", "mean"))), lambda m: m["mean"]).alias("means"))

    def leaf_gains(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all leaves, sorted, and for each the sum of its own and its ancestors' gains over their parents; zeros where there are none."""
        at = self.node_features().select("node_id", "feature_id", (F.col("mean") - F.coalesce("parent_mean", F.lit(0.0))).alias("gain")).toArrow()
        gains = np.zeros((len(self.forest.rows), self.width))
        gains[at["node_id"].to_numpy(), at["feature_id"].to_numpy()] = at["gain"].to_numpy()
        leaves = np.array([r[0] for r in self.forest.rows if r[6]], np.int64)
        place = {n: i for i, n in enumerate(leaves.tolist())}
        total = np.zeros((len(leaves), self.width))
        for node, up, _ in self.forest.closure:
            if node in place:
                total[place[node]] += gains[up]
        return leaves, total

    def predict(self, samples: DataFrame) -> Prediction:
        return Prediction(self, samples)

    def out_of_bag(self, samples: DataFrame, fold: int = 5) -> DataFrame:
        """``(sample_id, predicted)`` for a hash fold of ``samples`` by this forest: error on what wasn't drawn, if that fold was left out of the fit."""
        return self.predict(samples.where(F.pmod(F.xxhash64("sample_id", F.lit(self.params.seed)), F.lit(fold)) == 0)).predicted("mean")

    def trimmed(self, limit: float) -> ForestModel:
        """Nodes below the root whose coefficient of determination is under ``limit`` become leaves."""
        poor = {r.node_id for r in self.node_features().groupBy("node_id").agg((1 - F.try_divide(F.sum("sse"), F.sum("parent_sse"))).alias("cod")).where(F.col("cod") < limit).collect()}

        def cut(node: Split, number: dict[int, int], root: bool) -> Split:
            if node.left is None or (not root and number[id(node)] in poor):
                return Split()
            return Split(node.features, node.scores, node.means, node.split, cut(node.left, number, False), cut(node.right, number, False))

        trees = [cut(t, n, True) for t, n in zip(self.forest.trees, self.forest.numbers, strict=True)]
        return ForestModel(Forest(self.forest.spark, trees, self.forest.row_sum_scaling), self.samples, self.targets, self.params, self.names)

    def derived(self, samples: DataFrame, targets: DataFrame | None = None) -> ForestModel:
        """The forest over other samples: nodes with an empty child become leaves, samples keep their ids."""
        some = {r.node_id for r in self.forest.members(samples).select("node_id").distinct().collect()}

        def cut(node: Split, number: dict[int, int]) -> Split:
            if node.left is None or number[id(node.left)] not in some or number[id(node.right)] not in some:
                return Split()
            return Split(node.features, node.scores, node.means, node.split, cut(node.left, number), cut(node.right, number))

        trees = [cut(t, n) for t, n in zip(self.forest.trees, self.forest.numbers, strict=True)]
        return ForestModel(Forest(self.forest.spark, trees, self.forest.row_sum_scaling), samples, targets, self.params, self.names)

    def with_feature(self, values: DataFrame, name: str) -> ForestModel:
        """Targets with one more feature, ``values(sample_id, value)``; missing values are 0."""
        y = (self.samples.select("sample_id", F.col("x").alias("y")) if self.targets is None else self.targets.select("sample_id", "y")).join(values, "sample_id", "left")
        y = y.select("sample_id", F.array_append(F.col("y").cast("array<double>"), F.coalesce(F.col("value").cast("double"), F.lit(0.0))).alias("y"))
        return ForestModel(self.forest, self.samples, y, self.params, [*self.names, name])

    def without_feature(self, name: str) -> ForestModel:
        at = self.names.index(name)
        y = self.samples.select("sample_id", F.col("x").alias("y")) if self.targets is None else self.targets.select("sample_id", "y")
        y = y.select("sample_id", F.filter(F.col("y").cast("array<double>"), lambda v, i: i != at).alias("y"))
        return ForestModel(self.forest, self.samples, y, self.params, [n for n in self.names if n != name])

    def sample(self, sample_id: int) -> DataFrame:
        """``(feature_id, name, value)`` of one sample's targets: a point lookup."""
        y = self.samples.select("sample_id", F.col("x").alias("y")) if self.targets is None else self.targets
        names = F.array(*[F.lit(n) for n in self.names])
        return y.where(F.col("sample_id") == sample_id).select(F.posexplode(F.arrays_zip(names.alias("name"), F.col("y").cast("array<double>").alias("value"))).alias("feature_id", "v")).select("feature_id", "v.name", "v.value")

    # ---- storing

    def backup(self, path: str) -> None:
        """Nodes, matrices, names and parameters as Parquet and JSON under ``path``, which must not exist."""
        spark = self.forest.spark
        self.forest.nodes.coalesce(1).write.parquet(f"{path}/node")
        self.samples.select("sample_id", "x").write.parquet(f"{path}/sample")
        if self.targets is not None:
            self.targets.select("sample_id", "y").write.parquet(f"{path}/target")
        about = {"params": asdict(self.params), "names": self.names, "targets": self.targets is not None, "row_sum_scaling": self.forest.row_sum_scaling}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")

    @classmethod
    def restore(cls, spark: SparkSession, path: str) -> ForestModel:
        """The model that ``backup`` left under ``path``."""
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        rows = spark.read.parquet(f"{path}/node").collect()  # a few rows a tree
        targets = spark.read.parquet(f"{path}/target") if about["targets"] else None
        return cls(forest_from_rows(spark, rows, about["row_sum_scaling"]), spark.read.parquet(f"{path}/sample"), targets, ForestParams(**about["params"]), about["names"])


def forest_from_rows(spark: SparkSession, rows, row_sum_scaling: bool = False) -> Forest:
    """A forest from its node rows; a node's test is on the rows of its children."""
    kids: dict[int, list] = {}
    for r in rows:
        if r.parent_id is not None:
            kids.setdefault(r.parent_id, []).append(r)

    def made(node_id: int) -> Split:
        if node_id not in kids:
            return Split()
        left, right = sorted(kids[node_id], key=lambda r: r.lr)
        return Split(tuple(left.features), tuple(left.scores), tuple(left.means), left.split, made(left.node_id), made(right.node_id))

    roots = sorted((r.tree_id, r.node_id) for r in rows if r.parent_id is None)
    return Forest(spark, [made(n) for _, n in roots], row_sum_scaling)


def from_spark_forest(spark: SparkSession, model) -> Forest:
    """A forest from a fitted ``pyspark.ml`` random forest with continuous features; child order is kept."""

    def made(node) -> Split:
        if node.subtreeDepth() == 0:
            return Split()
        split = node.split()
        return Split((split.featureIndex(),), (1.0,), (0.0,), float(split.threshold()), made(node.leftChild()), made(node.rightChild()))

    return Forest(spark, [made(t._call_java("rootNode")) for t in model.trees])

