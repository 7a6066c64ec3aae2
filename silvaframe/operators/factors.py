"""Node clusters (factors) of a forest: finding them, their scores, changes, regressions and consensus tree.

Nodes and clusters are metadata, bounded by the forest; what is taken over
samples is summed in Spark first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .forest import Forest
from .model import ForestModel
from .neighbours import communities, knn
from .routing import Router, matrix

MODES = ("mean", "median", "additive", "additive_mean", "sample", "sister", "gain", "error_ratio", "partial", "factor", "weight")


def node_representation(model: ForestModel, mode: str = "additive_mean", clusters: DataFrame | None = None) -> DataFrame:
    """``(node_id, dim, value)`` of every node, sparse: a value that isn't there is 0.

    Dimensions are target features, or samples (``sample``, ``sister``) or
    clusters (``factor``, from ``clusters(cluster_id, node_id)``).
    """
    forest, features = model.forest, model.node_features
    nodes = forest.nodes.select("node_id", "parent_id", "sister_id", "is_leaf")
    up = F.coalesce("parent_mean", F.lit(0.0))
    if mode in ("mean", "additive_mean", "gain", "error_ratio"):
        parent = features().select(F.col("node_id").alias("parent_id"), "feature_id", F.col("sse").alias("up_sse"))
        value = {"mean": F.col("mean"), "additive_mean": F.col("mean") - up, "gain": F.coalesce(F.col("up_sse") - F.col("sse"), F.lit(0.0)), "error_ratio": (F.col("sse") + 1) / (F.when(F.col("parent_id").isNull(), F.col("sse")).otherwise(F.col("parent_sse")) + 1)}[mode]
        out = features().join(nodes, "node_id")
        if mode == "gain":
            out = out.join(parent, ["parent_id", "feature_id"], "left")
        return out.select("node_id", F.col("feature_id").alias("dim"), value.alias("value"))
    if mode in ("median", "additive"):
        y = model.samples.select("sample_id", F.posexplode("x").alias("feature_id", "value")) if model.targets is None else model.targets.select("sample_id", F.posexplode("y").alias("feature_id", "value"))
        own = forest.members(model.samples).join(y, "sample_id").groupBy("node_id", "feature_id").agg(F.median("value").alias("median"))
        if mode == "median":
            return own.select("node_id", F.col("feature_id").alias("dim"), F.col("median").alias("value"))
        above = own.select(F.col("node_id").alias("parent_id"), "feature_id", F.col("median").alias("up"))
        return own.join(nodes, "node_id").join(above, ["parent_id", "feature_id"], "left").select("node_id", F.col("feature_id").alias("dim"), (F.col("median") - F.coalesce("up", F.lit(0.0))).alias("value"))
    if mode == "partial":
        kids = features().join(nodes, "node_id").select(F.col("parent_id").alias("node_id"), "feature_id", F.col("n").alias("kid_n"), F.col("mean").alias("kid")).where("node_id is not null")
        apart = features().join(kids, ["node_id", "feature_id"], "left").groupBy("node_id", "feature_id", "sse", "mean", "parent_mean").agg(F.sum(F.col("kid_n") * (F.col("mean") - F.col("kid")) ** 2).alias("between"))
        gain = F.col("mean") - up
        return apart.select("node_id", F.col("feature_id").alias("dim"), F.when(F.col("between").isNull(), gain).when(F.col("sse") == 0, F.lit(0.0)).otherwise(gain * F.col("between") / F.col("sse")).alias("value"))
    if mode in ("sample", "sister"):
        member = forest.members(model.samples)
        own = member.select("node_id", F.col("sample_id").alias("dim"), F.lit(1.0).alias("value"))
        if mode == "sample":
            return own
        other = member.join(nodes.where("sister_id is not null").select(F.col("node_id").alias("own_id"), F.col("sister_id").alias("node_id")), "node_id")
        return own.unionByName(other.select(F.col("own_id").alias("node_id"), F.col("sample_id").alias("dim"), F.lit(-1.0).alias("value")))
    if mode == "factor" and clusters is not None:
        return clusters.select("node_id", F.col("cluster_id").alias("dim"), F.lit(1.0).alias("value"))
    if mode == "weight":
        return nodes.select("node_id", F.explode(F.sequence(F.lit(0), F.lit(model.width - 1))).alias("dim"), F.lit(1.0).alias("value"))
    raise ValueError(f"mode is one of {MODES}; factor needs clusters")


def vectors(long: DataFrame, width: int) -> DataFrame:
    """``(id, x)`` of a long table ``(node_id, dim, value)``, dense over ``width`` dimensions."""
    got = long.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("dim").cast("int"), "value"))).alias("got"))
    return got.select(F.col("node_id").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: F.coalesce(F.try_element_at("got", d), F.lit(0.0))).alias("x"))


#: Numbers of shared samples that a task holds; more pairs of leaves are further passes over the samples.
SHARED = 4_000_000


def _shared(held, lo: int, hi: int):
    """Rows of (node, samples shared with each node), for the pairs whose first leaf is one of ``lo`` to ``hi``."""

    def run(batches):
        states, leaves, nodes, of, up = held.value
        routers = [Router.of(s) for s in states]
        n = len(leaves)
        counts = np.zeros((hi - lo) * n, np.int64)
        for batch in batches:
            reached = np.searchsorted(leaves, np.concatenate([r.leaves(matrix(batch.column(1))) for r in routers], 1))
            step = max(1, 1_000_000 // reached.shape[1] ** 2)
            for k in range(0, len(reached), step):
                some = reached[k : k + step]
                pairs = (some[:, :, None] - lo) * n + some[:, None, :]
                mine = np.broadcast_to(((some >= lo) & (some < hi))[:, :, None], pairs.shape)
                np.add.at(counts, pairs[mine], 1)
        within = (of >= lo) & (of < hi)
        wide = np.zeros((len(nodes), hi - lo), np.int64)
        np.add.at(wide, up, counts.reshape(hi - lo, n).T[of])  # second leaves to all nodes above
        for node in np.unique(up[within]):
            row = wide[:, of[within & (up == node)] - lo].sum(1)
            if row.any():
                yield pa.RecordBatch.from_arrays([pa.array(nodes[node : node + 1]), pa.array([row], pa.list_(pa.int64()))], names=["node_id", "shared"])

    return run


def overlaps(forest: Forest, samples: DataFrame) -> DataFrame:
    """``(id, x)`` of every node with samples, for ``knn`` by ``overlap``: its place among the nodes, then how many samples it shares with the node at each place.

    Samples are read where they are, and only sums leave a task: nothing is as
    wide as there are samples, and their ids don't matter.
    """
    nodes = np.array(sorted(forest.parent), np.int64)
    leaves = np.array(sorted(r[0] for r in forest.rows if r[6]), np.int64)
    own = set(leaves.tolist())
    closure = np.array([(a, b) for a, b, _ in forest.closure if a in own], np.int64).reshape(-1, 2)
    held = forest.spark.sparkContext.broadcast(([r.__dict__ for r in forest.routers()], leaves, nodes, np.searchsorted(leaves, closure[:, 0]), np.searchsorted(nodes, closure[:, 1])))
    rows = samples.select("sample_id", F.col("x").cast("array<double>").alias("x"))
    step = max(1, SHARED // len(nodes))
    parts = None
    for lo in range(0, len(leaves), step):
        part = rows.mapInArrow(_shared(held, lo, min(len(leaves), lo + step)), "node_id long, shared array<long>")
        parts = part if parts is None else parts.unionByName(part)
    cells = parts.select("node_id", F.posexplode("shared").alias("at", "n")).groupBy("node_id", "at").agg(F.sum("n").cast("double").alias("n"))
    got = cells.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda v: v["n"]).alias("shared"))
    place = forest.spark.createDataFrame([(i, float(k)) for k, i in enumerate(nodes.tolist())], "node_id long, place double")
    return got.join(place, "node_id").select(F.col("node_id").alias("id"), F.concat(F.array("place"), "shared").alias("x"))


def principal(rows: DataFrame, k: int) -> DataFrame:
    """``(id, x)``: ``rows(id, x)`` by their first ``k`` principal components, centred."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.select("id", array_to_vector("x").alias("v"))
    data = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(data).transform(data)
    out = PCA(k=k, inputCol="c", outputCol="p").fit(data).transform(data)
    return out.select("id", vector_to_array("p").alias("x"))


def interpret_splits(model: ForestModel, mode: str = "additive_mean", metric: str = "cosine", k: int = 10, depth: int | None = None, resolution: float = 1.0, double: bool = False, pca: int = 0) -> DataFrame:
    """``(cluster_id, node_id)``: roots are cluster 0, other nodes down to ``depth`` communities from 1 on.

    With ``double`` the distance is the mean of that of a node's representation
    and that of its sister's, both by the same components if ``pca`` asks for
    some. Isolated nodes are a community each.
    """
    forest = model.forest
    nodes = forest.nodes.select("node_id", "parent_id", "sister_id", "level")
    if depth is not None:
        nodes = nodes.where(F.col("level") <= depth)
    stems = nodes.where("parent_id is not null")
    rows = vectors(node_representation(model, mode), model.width)
    if pca:
        rows = principal(rows, min(pca, model.width))
    own = rows.join(stems.select(F.col("node_id").alias("id")), "id", "left_semi")
    if double:
        other = rows.select(F.col("id").alias("sister_id"), F.col("x").alias("x2"))
        own = own.join(stems.select(F.col("node_id").alias("id"), "sister_id"), "id").join(other, "sister_id").select("id", "x", "x2")
    found = communities(knn(own, k, metric, metric if double else None), resolution)
    top = max(found.values(), default=-1) + 1
    rows_ = []
    for r in sorted(nodes.select("node_id", "parent_id").collect()):
        if r.parent_id is None:
            rows_.append((0, r.node_id))
        elif r.node_id in found:
            rows_.append((1 + found[r.node_id], r.node_id))
        else:
            top += 1
            rows_.append((top, r.node_id))
    return forest.spark.createDataFrame(rows_, "cluster_id int, node_id long")


def propagated(forest: Forest, clusters: DataFrame) -> DataFrame:
    """``(node_id, cluster_id)``: a node's own label, or that of its nearest labelled ancestor; others are left out."""
    near = forest.path.join(clusters.withColumnRenamed("node_id", "ancestor_id"), "ancestor_id")
    return near.groupBy("node_id").agg(F.min_by("cluster_id", F.struct("distance", "cluster_id")).alias("cluster_id"))


def child_clusters(forest: Forest, clusters: DataFrame) -> DataFrame:
    """``(node_id, lr, cluster_id, times)``: labelled nodes below each node, by the side on which they are."""
    kid = forest.nodes.select(F.col("node_id").alias("kid_id"), F.col("parent_id").alias("node_id"), "lr").where("node_id is not null")
    below = forest.path.select(F.col("node_id").alias("under_id"), F.col("ancestor_id").alias("kid_id"))
    named = clusters.select("cluster_id", F.col("node_id").alias("under_id"))
    return kid.join(below, "kid_id").join(named, "under_id").groupBy("node_id", "lr", "cluster_id").agg(F.count(F.lit(1)).alias("times"))


# ---- scores of samples


def scores(model: ForestModel, clusters: DataFrame, prior: float = 1.0) -> DataFrame:
    """``(cluster_id, sample_id, own, sister, parent, score, parent_score, sister_score, log_sister)`` wherever one isn't 0.

    Counts of a cluster's nodes, their sisters, and their parents (or own nodes
    where there is no parent) that hold a sample; scores are counts over nodes
    plus 1, the sister score own less sister over nodes.
    """
    nodes = model.forest.nodes.select("node_id", "parent_id", "sister_id")
    member = model.forest.members(model.samples)
    sized = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    at = clusters.join(nodes, "node_id")
    roles = at.select("cluster_id", "node_id", F.lit("own").alias("role"))
    roles = roles.unionByName(at.where("sister_id is not null").select("cluster_id", F.col("sister_id").alias("node_id"), F.lit("sister").alias("role")))
    roles = roles.unionByName(at.select("cluster_id", F.coalesce("parent_id", "node_id").alias("node_id"), F.lit("parent").alias("role")))
    small = Forest._small(roles, len(model.forest.rows) * 40)
    count = [F.count(F.when(F.col("role") == r, 1)).cast("double").alias(r) for r in ("own", "sister", "parent")]
    got = member.join(small, "node_id").groupBy("cluster_id", "sample_id").agg(*count).join(F.broadcast(sized), "cluster_id")
    return got.select("cluster_id", "sample_id", "own", "sister", "parent", (F.col("own") / (F.col("n") + 1)).alias("score"), (F.col("parent") / (F.col("n") + 1)).alias("parent_score"), ((F.col("own") - F.col("sister")) / F.col("n")).alias("sister_score"), F.log((F.col("own") + prior) / (F.col("sister") + prior)).alias("log_sister"))


# ---- change tables


def changes(model: ForestModel, clusters: DataFrame, against: str = "parent", log: bool = False) -> DataFrame:
    """``(cluster_id, feature_id, value, place)``: mean of a cluster's node means less that of its parents, sisters or roots.

    With ``log`` the binary logarithm of the ratio, where both are positive.
    Places go up from the most negative change.
    """
    nodes = model.forest.nodes
    root = model.forest.path.join(nodes.where("parent_id is null").select(F.col("node_id").alias("ancestor_id")), "ancestor_id").select("node_id", F.col("ancestor_id").alias("other_id"))
    pairs = {"parent": nodes.select("node_id", F.col("parent_id").alias("other_id")), "sister": nodes.select("node_id", F.col("sister_id").alias("other_id")), "root": root}[against]
    means = model.node_features().select("node_id", "feature_id", "mean")
    at = clusters.join(pairs, "node_id").where("other_id is not null")
    own = at.join(means, "node_id").groupBy("cluster_id", "feature_id").agg(F.avg("mean").alias("own"))
    other = at.select("cluster_id", F.col("other_id").alias("node_id")).join(means, "node_id").groupBy("cluster_id", "feature_id").agg(F.avg("mean").alias("other"))
    both = own.join(other, ["cluster_id", "feature_id"])
    if log:
        both = both.where("own > 0 and other > 0").withColumn("value", F.log2(F.col("own") / F.col("other")))
    else:
        both = both.withColumn("value", F.col("own") - F.col("other"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.round("value", 9), "feature_id"))
    return both.select("cluster_id", "feature_id", "value", place.cast("long").alias("place"))


def logistic_change(model: ForestModel, clusters: DataFrame, cluster_id: int, against: str = "sister", ridge: float = 1.0) -> DataFrame:
    """``(feature_id, coefficient, place)`` of a logistic regression that tells a cluster's node means from its sisters' or parents'."""
    nodes = model.forest.nodes.select("node_id", F.col(f"{against}_id").alias("other_id"))
    at = clusters.where(F.col("cluster_id") == cluster_id).join(nodes, "node_id").where("other_id is not null")
    sides = at.select("node_id", F.lit(1.0).alias("label")).unionByName(at.select(F.col("other_id").alias("node_id"), F.lit(0.0).alias("label")))
    rows = vectors(node_representation(model, "mean"), model.width).join(sides, F.col("id") == F.col("node_id"))
    return _logistic(rows, ridge)


def sample_logistic(model: ForestModel, labels: DataFrame, cluster_id: int, ridge: float = 1.0) -> DataFrame:
    """``(feature_id, coefficient, place)`` of one sample cluster against the rest, on standardised targets; ``labels(sample_id, cluster_id)``."""
    y = model.samples.select("sample_id", "x") if model.targets is None else model.targets.select("sample_id", F.col("y").alias("x"))
    rows = y.join(labels, "sample_id").select(F.col("x").cast("array<double>").alias("x"), (F.col("cluster_id") == cluster_id).cast("double").alias("label"))
    return _logistic(rows, ridge, True)


def _logistic(rows: DataFrame, ridge: float, scale: bool = False) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector("x").alias("features"), "label")
    n = data.count()
    if data.select("label").distinct().count() < 2:
        return rows.sparkSession.createDataFrame([], "feature_id int, coefficient double, place long")
    fit = LogisticRegression(regParam=ridge / n, standardization=scale).fit(data)
    value = np.array(fit.coefficients.toArray())
    order = np.lexsort((np.arange(len(value)), value.round(9)))
    return rows.sparkSession.createDataFrame([(int(i), float(value[i]), p + 1) for p, i in enumerate(order)], "feature_id int, coefficient double, place long")


# ---- weighted regressions


def regressions(model: ForestModel, clusters: DataFrame, ridge: float = 1e-9) -> DataFrame:
    """``(cluster_id, target, input, coefficient)``: least squares of a factor's sister score and of every target on the factor's split features.

    Samples weigh by the absolute sister score. ``target`` -1 is the score
    itself, ``input`` -1 the constant. Only sums of products leave the
    executors: (split features + 1) x (targets + 1) numbers a cluster.
    """
    nodes = model.forest.nodes.select("node_id", "features")
    used = clusters.join(nodes, "node_id").select("cluster_id", F.explode("features").alias("f")).groupBy("cluster_id").agg(F.array_sort(F.collect_set("f")).alias("inputs"))
    inputs = {r.cluster_id: r.inputs for r in used.collect()}
    some = scores(model, clusters).where("sister_score <> 0").select("cluster_id", "sample_id", "sister_score")
    y = model.samples.select("sample_id", "x", F.col("x").alias("y")) if model.targets is None else model.samples.select("sample_id", "x").join(model.targets.select("sample_id", "y"), "sample_id")
    rows = some.join(y, "sample_id").select("cluster_id", "sister_score", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"))
    got = rows.mapInArrow(_products(inputs), "cluster_id int, part binary, rows int")
    out = []
    sums: dict[int, np.ndarray] = {}
    for r in got.toLocalIterator():  # a matrix for each cluster and task
        m = np.frombuffer(r.part).reshape(r.rows, -1)
        sums[r.cluster_id] = sums.get(r.cluster_id, 0) + m
    for c, m in sorted(sums.items()):
        k = len(m)
        beta = np.linalg.solve(m[:, :k] + ridge * np.eye(k), m[:, k:])
        out += [(c, t - 1, ([-1, *inputs[c]])[i], float(beta[i, t])) for t in range(beta.shape[1]) for i in range(k)]
    return model.forest.spark.createDataFrame(out, "cluster_id int, target int, input int, coefficient double")


def _products(inputs: dict[int, list[int]]):
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            c, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x, y = matrix(batch.column(2)), matrix(batch.column(3))
            for k in np.unique(c).tolist():
                if k not in inputs:
                    continue
                at = c == k
                z = np.column_stack((np.ones(at.sum()), x[at][:, inputs[k]]))
                w = np.abs(s[at])[:, None]
                sums[k] = sums.get(k, 0) + (w * z).T @ np.column_stack((z, s[at], y[at]))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary()), pa.array([len(m) for m in sums.values()], pa.int32())], names=["cluster_id", "part", "rows"])

    return run


def top_split_features(model: ForestModel, clusters: DataFrame, n: int = 10) -> DataFrame:
    """``(cluster_id, feature_id, coefficient, place)``: a factor's split features by the size of their coefficient for its score."""
    score = regressions(model, clusters).where("target = -1 and input >= 0").select("cluster_id", F.col("input").alias("feature_id"), "coefficient")
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.round(F.abs("coefficient"), 9).desc(), "feature_id")).cast("long")
    return score.withColumn("place", place).where(F.col("place") <= n)


def important_features(model: ForestModel, clusters: DataFrame, n: int = 3) -> DataFrame:
    """``(cluster_id, feature_id)``: the ``n`` features of least and of greatest change against sisters."""
    at = changes(model, clusters, "sister")
    last = F.max("place").over(Window.partitionBy("cluster_id"))
    return at.withColumn("last", last).where((F.col("place") <= n) | (F.col("place") > F.col("last") - n)).select("cluster_id", "feature_id")


# ---- errors


def strict_errors(model: ForestModel, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(cluster_id, feature_id, value)`` and ``(cluster_id, fvu)``: errors about own over errors about parents' means, nodes with a parent only."""
    with_parent = model.forest.nodes.where("parent_id is not null").select("node_id")
    at = clusters.join(with_parent, "node_id").join(model.node_features(), "node_id")
    by = at.groupBy("cluster_id", "feature_id").agg(((F.sum("sse") + 1) / (F.sum("parent_sse") + 1)).alias("value"))
    return by, at.groupBy("cluster_id").agg(F.try_divide(F.sum("sse"), F.sum("parent_sse")).alias("fvu"))


def local_correlations(model: ForestModel, clusters: DataFrame, features: list[int]) -> DataFrame:
    """``(cluster_id, feature_a, feature_b, local, whole, delta)`` for pairs a < b of some features, weighted by own counts."""
    y = model.samples.select("sample_id", F.col("x").alias("y")) if model.targets is None else model.targets
    pairs = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.element_at("y", a + 1).cast("double").alias("a"), F.element_at("y", b + 1).cast("double").alias("b")) for i, a in enumerate(features) for b in features[i + 1 :]])
    values = y.select("sample_id", F.explode(pairs).alias("p")).select("sample_id", "p.*")
    whole = values.groupBy("feature_a", "feature_b").agg(F.corr("a", "b").alias("whole"))
    at = scores(model, clusters).where("own > 0").select("cluster_id", "sample_id", F.col("own").alias("w")).join(values, "sample_id")
    w = F.sum("w")

    def mean(x: Column) -> Column:
        return F.sum(F.col("w") * x) / w

    a, b = F.col("a"), F.col("b")
    local = F.try_divide(mean(a * b) - mean(a) * mean(b), F.sqrt((mean(a * a) - mean(a) ** 2) * (mean(b * b) - mean(b) ** 2)))
    got = at.groupBy("cluster_id", "feature_a", "feature_b").agg(F.coalesce(local, F.lit(0.0)).alias("local"))
    return got.join(F.broadcast(whole), ["feature_a", "feature_b"]).select("cluster_id", "feature_a", "feature_b", "local", "whole", (F.col("local") - F.col("whole")).alias("delta"))


def most_local(model: ForestModel, clusters: DataFrame, features: list[int], n: int = 10) -> DataFrame:
    """The ``n`` pairs of each cluster whose correlation differs most from that over all samples."""
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.round(F.abs("delta"), 9).desc(), "feature_a", "feature_b")).cast("long")
    return local_correlations(model, clusters, features).withColumn("place", place).where(F.col("place") <= n)


def enrichment(forest: Forest, clusters: DataFrame) -> DataFrame:
    """``(cluster_id, downstream, value)``: share of a label among a cluster's strict descendants over its share below the roots."""
    label = propagated(forest, clusters).select(F.col("node_id"), F.col("cluster_id").alias("downstream"))
    below = forest.path.where("distance > 0").join(label, "node_id")
    of = below.join(clusters.withColumnRenamed("node_id", "ancestor_id"), "ancestor_id").groupBy("cluster_id", "downstream").agg(F.count(F.lit(1)).alias("k"))
    of = of.withColumn("share", F.col("k") / F.sum("k").over(Window.partitionBy("cluster_id")))
    roots = forest.nodes.where("parent_id is null").select(F.col("node_id").alias("ancestor_id"))
    base = below.join(roots, "ancestor_id").groupBy("downstream").agg(F.count(F.lit(1)).alias("k"))
    base = base.select("downstream", (F.col("k") / F.sum("k").over(Window.partitionBy())).alias("base"))  # one row a cluster
    return of.join(F.broadcast(base), "downstream").select("cluster_id", "downstream", (F.col("share") / F.col("base")).alias("value"))


# ---- consensus tree


def transitions(forest: Forest, clusters: DataFrame, depth: int | None = None) -> DataFrame:
    """``(parent, child, value)``: how often a node of one cluster has a child of another.

    A leaf (or a node at ``depth``) counts as a child -1, a root as having the
    parent -1. Nodes take the label of their nearest labelled ancestor.
    """
    label = propagated(forest, clusters)
    nodes = forest.nodes.select("node_id", "parent_id", "level", "is_leaf").join(label, "node_id")
    if depth is not None:
        nodes = nodes.where(F.col("level") <= depth).withColumn("is_leaf", F.col("is_leaf") | (F.col("level") == depth))
    up = label.select(F.col("node_id").alias("parent_id"), F.col("cluster_id").alias("parent"))
    steps = nodes.join(up, "parent_id", "left").select(F.coalesce("parent", F.lit(-1)).alias("parent"), F.col("cluster_id").alias("child"))
    ends = nodes.where("is_leaf").select(F.col("cluster_id").alias("parent"), F.lit(-1).alias("child"))
    return steps.unionByName(ends).groupBy("parent", "child").agg(F.count(F.lit(1)).alias("value"))


def square(table: DataFrame, value: str = "value") -> np.ndarray:
    """The matrix of ``table(parent, child, value)`` over clusters 0 to C - 1; -1 is left out. C is bounded by the forest."""
    rows = [(r[0], r[1], r[2]) for r in table.select("parent", "child", value).collect()]
    n = 1 + max((max(a, b) for a, b, _ in rows), default=-1)
    out = np.zeros((n, n))
    for a, b, v in rows:
        if a >= 0 and b >= 0:
            out[a, b] = v or 0.0
    return out


def likely_tree(affinity: np.ndarray) -> list[tuple[int, int | None, int]]:
    """(cluster, parent, depth) from cluster 0 on: each cluster's parent is the strongest, the first on ties."""
    m = affinity.copy()
    np.fill_diagonal(m, 0)
    n = len(m)
    parent = {c: int(m[:, c].argmax()) for c in range(1, n) if m[:, c].max(initial=0) > 0}
    out, seen, front = ([(0, None, 0)] if n else []), {0}, [0]
    depth = 0
    while front:
        depth += 1
        new = [c for c in range(n) if parent.get(c) in front and c not in seen]
        out += [(c, parent[c], depth) for c in new]
        seen |= set(new)
        front = new
    return out


def spanning_tree(affinity: np.ndarray) -> list[tuple[int, int | None, int]]:
    """(cluster, parent, depth) of the maximum spanning tree, rooted at 0; no edge where the affinity is 0, what can't be reached is left out."""
    m = np.maximum(affinity, affinity.T).copy()
    np.fill_diagonal(m, 0)
    if not len(m):
        return []
    out, depth = [(0, None, 0)], {0: 0}
    while True:
        edges = [(-m[a, b], a, b) for a in depth for b in range(len(m)) if b not in depth and m[a, b] > 0]
        if not edges:
            return out
        _, a, b = min(edges)
        depth[b] = depth[a] + 1
        out.append((b, a, depth[b]))


def affinity(model: ForestModel, clusters: DataFrame, mode: str = "samples") -> DataFrame:
    """``(parent, child, value)`` between clusters, for a spanning tree.

    ``samples``: cosine of a cluster's parent scores and another's own scores,
    each sample's scores divided by their sum. ``means``: 1 less the cosine
    distance of mean node means. ``transitions``: counts, both ways.
    """
    if mode == "transitions":
        return transitions(model.forest, clusters).where("parent >= 0 and child >= 0 and parent <> child")
    if mode == "means":
        at = clusters.join(model.node_features(), "node_id").groupBy("cluster_id", F.col("feature_id").alias("dim")).agg(F.avg("mean").alias("a"))
        b = at.select(F.col("cluster_id").alias("child"), "dim", F.col("a").alias("b"))
        a = at.withColumnRenamed("cluster_id", "parent")
    else:
        some = scores(model, clusters)
        whole = some.groupBy("sample_id").agg(F.sum("score").alias("own_all"), F.sum("parent_score").alias("parent_all"))
        some = some.join(whole, "sample_id")
        a = some.select(F.col("cluster_id").alias("parent"), F.col("sample_id").alias("dim"), F.try_divide("parent_score", "parent_all").alias("a"))
        b = some.select(F.col("cluster_id").alias("child"), F.col("sample_id").alias("dim"), F.try_divide("score", "own_all").alias("b"))
    size_a = a.groupBy("parent").agg(F.sqrt(F.sum(F.col("a") ** 2)).alias("size_a"))
    size_b = b.groupBy("child").agg(F.sqrt(F.sum(F.col("b") ** 2)).alias("size_b"))
    dot = a.join(b, "dim").groupBy("parent", "child").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    return dot.join(F.broadcast(size_a), "parent").join(F.broadcast(size_b), "child").where("parent <> child").select("parent", "child", F.coalesce(F.try_divide("dot", F.col("size_a") * F.col("size_b")), F.lit(0.0)).alias("value"))


def tree_table(spark: SparkSession, tree: list[tuple[int, int | None, int]]) -> DataFrame:
    """``(cluster_id, parent_id, depth)`` of a consensus tree."""
    return spark.createDataFrame(tree, "cluster_id int, parent_id int, depth int")


def relations(tree: list[tuple[int, int | None, int]], cluster_id: int) -> dict[str, list[int]]:
    """Parent, children and siblings of a cluster in a consensus tree; empty lists where there are none."""
    up = {c: p for c, p, _ in tree}
    if cluster_id not in up:
        return {"parent": [], "children": [], "siblings": []}
    p = up[cluster_id]
    return {"parent": [] if p is None else [p], "children": sorted(c for c in up if up[c] == cluster_id), "siblings": sorted(c for c in up if p is not None and up[c] == p and c != cluster_id)}


def partial_dependence(forest: Forest, clusters: DataFrame) -> np.ndarray:
    """Pseudo-inverse of the covariance of cluster memberships over nodes, normalised by its diagonal; 0 where that is 0."""
    n = len(forest.rows)
    pair = clusters.alias("a").join(clusters.alias("b"), F.col("a.node_id") == F.col("b.node_id")).groupBy(F.col("a.cluster_id").alias("parent"), F.col("b.cluster_id").alias("child")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    both = square(pair)
    share = np.diag(both) / n
    inverse = np.linalg.pinv(both / n - np.outer(share, share))
    size = np.sqrt(np.abs(np.outer(np.diag(inverse), np.diag(inverse))))
    return np.divide(inverse, size, out=np.zeros_like(inverse), where=size > 0)


def layout(tree: list[tuple[int, int | None, int]], width: dict[int, float]) -> list[tuple[int, float, int, float]]:
    """(cluster, x, depth, width) of a consensus tree: leaves side by side in order, parents over the middle of theirs."""
    kids: dict[int | None, list[int]] = {}
    depth = {c: d for c, _, d in tree}
    for c, p, _ in tree:
        kids.setdefault(p, []).append(c)
    at: dict[int, float] = {}
    free = 0
    for c in sorted(depth, key=lambda c: -depth[c]):
        if c not in kids:
            at[c] = -1.0
    stack = [(c, False) for c in reversed(kids.get(None, []))]
    while stack:
        c, done = stack.pop()
        if c not in kids:
            at[c] = float(free)
            free += 1
        elif done:
            at[c] = sum(at[k] for k in kids[c]) / len(kids[c])
        else:
            stack.append((c, True))
            stack += [(k, False) for k in reversed(sorted(kids[c]))]
    return [(c, at[c], depth[c], width.get(c, 0.0)) for c in sorted(depth)]
