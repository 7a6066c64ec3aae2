"""Comparing two populations through one forest: factor by factor, feature by feature."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import two_sided
from .forest import Forest
from .model import ForestModel
from .order import jackknife, kolmogorov_smirnov, rank_sum


def node_errors(model: ForestModel, samples: DataFrame) -> DataFrame:
    """``(node_id, feature_id, n, sse, parent_sse, mean)`` of other samples about the *training* means of a node and its parent.

    A root's parent mean is 0. Nodes without samples are left out. One pass.
    """
    own = model.node_features().select("node_id", "feature_id", F.col("mean").alias("m"), F.coalesce("parent_mean", F.lit(0.0)).alias("up"))
    new = model.forest.node_sums(samples)

    def about(c: str):
        return F.greatest(F.lit(0.0), F.col("q") - 2 * F.col(c) * F.col("s") + F.col("n") * F.col(c) ** 2)

    return new.join(own, ["node_id", "feature_id"]).select("node_id", "feature_id", "n", about("m").alias("sse"), about("up").alias("parent_sse"), (F.col("s") / F.col("n")).alias("mean"))


def node_fractions(forest: Forest, samples: DataFrame) -> DataFrame:
    """``(node_id, fraction)``: samples of a node over those of its parent; 1 for roots, 0 where the parent has none."""
    n = forest.members(samples).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    up = n.select(F.col("node_id").alias("parent_id"), F.col("n").alias("up"))
    at = forest.nodes.select("node_id", "parent_id").join(n, "node_id", "left").join(up, "parent_id", "left")
    return at.select("node_id", F.when(F.col("parent_id").isNull(), F.lit(1.0)).otherwise(F.coalesce(F.coalesce("n", F.lit(0)) / F.col("up"), F.lit(0.0))).alias("fraction"))


def factor_fractions(model: ForestModel, own: DataFrame, other: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(cluster_id, rank_sum, u, z, p)`` of node fractions of one population against another's, cluster by cluster."""
    both = node_fractions(model.forest, own).withColumn("other", F.lit(0)).unionByName(node_fractions(model.forest, other).withColumn("other", F.lit(1)))
    return rank_sum(clusters.join(both, "node_id").withColumn("fraction", F.round("fraction", 9)), ["cluster_id"], "fraction", "other")


def factor_residuals(model: ForestModel, own: DataFrame, other: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(cluster_id, delta, z, p)``: node errors of one population less another's over their jackknife deviation."""
    def mse(samples, name):
        at = node_errors(model, samples).groupBy("node_id").agg((F.sum("sse") / F.sum("n")).alias("mse"))
        return jackknife(clusters.join(at, "node_id"), ["cluster_id"], F.col("mse")).select("cluster_id", F.col("mean").alias(name), F.col("variance").alias(f"v_{name}"))

    at = mse(own, "a").join(mse(other, "b"), "cluster_id")
    both = F.col("v_a") + F.col("v_b")
    z = F.when(both > 1e-18, (F.col("b") - F.col("a")) / F.sqrt(both))  # nodes that are all alike have no deviation
    return at.select("cluster_id", (F.col("b") - F.col("a")).alias("delta"), z.alias("z"), two_sided(z).alias("p"))


def factor_fvu(model: ForestModel, own: DataFrame, other: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(cluster_id, fvu, other_fvu, u, p)``: unexplained variance of both populations, and the rank test of their nodes' coefficients of determination."""
    parts = []
    for side, samples in enumerate((own, other)):
        parts.append(clusters.join(node_errors(model, samples), "node_id").groupBy("cluster_id", "node_id").agg(F.sum("sse").alias("sse"), F.sum("parent_sse").alias("up")).withColumn("other", F.lit(side)))
    both = parts[0].unionByName(parts[1])
    fvu = both.groupBy("cluster_id").agg(*[F.try_divide(F.sum(F.when(F.col("other") == k, F.col("sse"))), F.sum(F.when(F.col("other") == k, F.col("up")))).alias(c) for k, c in enumerate(("fvu", "other_fvu"))])
    test = rank_sum(both.withColumn("cod", F.round(1 - F.try_divide("sse", "up"), 9)).where("cod is not null"), ["cluster_id"], "cod", "other")
    return fvu.join(test, "cluster_id").select("cluster_id", "fvu", "other_fvu", "u", "p")


def factor_values(own: DataFrame, other: DataFrame, bins: int = 10) -> DataFrame:
    """``(cluster_id, kl, u, p, ks)`` of two tables ``(cluster_id, value)`` with values from -1 to 1.

    The divergence is symmetric, over histograms of ``bins`` equal bins in
    which every bin that either has counts once more.
    """
    width = 2 / bins
    both = own.withColumn("other", F.lit(0)).unionByName(other.withColumn("other", F.lit(1)))
    at = both.withColumn("bin", F.floor((F.col("value") + 1) / width)).groupBy("cluster_id", "bin").agg((F.sum(1 - F.col("other")) + 1).alias("a"), (F.sum("other") + 1).alias("b"))
    whole = at.groupBy("cluster_id").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    p, q = F.col("a") / F.col("n_a"), F.col("b") / F.col("n_b")
    kl = at.join(whole, "cluster_id").groupBy("cluster_id").agg(F.sum((p - q) * (F.log(p) - F.log(q))).alias("kl"))
    test, ks = rank_sum(both, ["cluster_id"], "value", "other"), kolmogorov_smirnov(both, ["cluster_id"], "value", "other")
    return kl.join(test, "cluster_id").join(ks, "cluster_id").select("cluster_id", "kl", "u", "p", "ks")


def factor_marginals(model: ForestModel, own: DataFrame, other: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(cluster_id, own_distance, other_distance)``: mean cosine distance of both populations' node marginals to the first's mean marginal.

    A marginal is a node's observed mean less its parent's; roots and empty nodes have zeros.
    """
    def marginal(samples):
        sums = model.forest.node_sums(samples).select("node_id", "feature_id", (F.col("s") / F.col("n")).alias("mean"))
        up = sums.select(F.col("node_id").alias("parent_id"), "feature_id", F.col("mean").alias("up"))
        return sums.join(model.forest.nodes.select("node_id", "parent_id"), "node_id").join(up, ["parent_id", "feature_id"]).select("node_id", "feature_id", (F.col("mean") - F.col("up")).alias("value"))

    own_m = clusters.join(marginal(own), "node_id")
    other_m = clusters.join(marginal(other), "node_id")
    centre = own_m.groupBy("cluster_id", "feature_id").agg(F.avg("value").alias("centre"))

    def distance(table, name):
        at = table.join(centre, ["cluster_id", "feature_id"]).groupBy("cluster_id", "node_id").agg(F.sum(F.col("value") * F.col("centre")).alias("ab"), F.sum(F.col("value") ** 2).alias("aa"), F.sum(F.col("centre") ** 2).alias("bb"))
        return at.groupBy("cluster_id").agg(F.avg(1 - F.coalesce(F.try_divide("ab", F.sqrt(F.col("aa") * F.col("bb"))), F.lit(0.0))).alias(name))

    return distance(own_m, "own_distance").join(distance(other_m, "other_distance"), "cluster_id")


def factor_means(model: ForestModel, other: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(cluster_id, other_distance, rank, nodes)``: how far another population's node means lie from a factor's centre.

    ``rank`` is how many of the factor's own nodes lie nearer to it than the
    other population's do on average.
    """
    means = clusters.join(model.node_features().select("node_id", "feature_id", "mean"), "node_id")
    centre = means.groupBy("cluster_id", "feature_id").agg(F.avg("mean").alias("centre"))
    new = clusters.join(model.forest.node_sums(other).select("node_id", "feature_id", (F.col("s") / F.col("n")).alias("mean")), "node_id")

    def apart(table):
        return table.join(centre, ["cluster_id", "feature_id"]).groupBy("cluster_id", "node_id").agg(F.sqrt(F.sum((F.col("mean") - F.col("centre")) ** 2)).alias("d"))

    far = apart(new).groupBy("cluster_id").agg(F.avg("d").alias("other_distance"))
    return apart(means).join(F.broadcast(far), "cluster_id").groupBy("cluster_id", "other_distance").agg(F.count(F.when(F.col("d") < F.col("other_distance"), 1)).alias("rank"), F.count(F.lit(1)).alias("nodes")).select("cluster_id", "other_distance", "rank", "nodes")


def compare_factors(model: ForestModel, own: DataFrame, other: DataFrame, clusters: DataFrame) -> DataFrame:
    """All comparisons of each factor but 0 in one row: fractions, residuals, unexplained variance and means."""
    some = clusters.where("cluster_id <> 0")
    out = factor_fvu(model, own, other, some).withColumnsRenamed({"u": "fvu_u", "p": "fvu_p"})
    for table, name in ((factor_fractions(model, own, other, some).select("cluster_id", "u", "p"), "fraction"), (factor_residuals(model, own, other, some).select("cluster_id", "z", "p"), "residual"), (factor_means(model, other, some).select("cluster_id", "rank"), "mean")):
        out = out.join(table.select("cluster_id", *[F.col(c).alias(f"{name}_{c}") for c in table.columns if c != "cluster_id"]), "cluster_id", "left")
    return out


def student_t_two_sided(t: float, df: float) -> float:
    """Chance of a Student-t number as far from 0 as ``t``, by its incomplete beta function."""
    x = df / (df + t * t)
    return _beta(df / 2, 0.5, x)


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            n = 1.0
        elif i % 2 == 0:
            n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or 1e-300)
        c = 1 + n / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return float(np.clip(front * (f - 1), 0, 1))
