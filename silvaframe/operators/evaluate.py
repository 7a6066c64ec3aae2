"""Evaluation protocols: preprocessing, baselines, agreement of labelings, cross-validation, simulations."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .compare import factor_fvu
from .model import ForestModel
from .routing import matrix


def filtered(cells: DataFrame, least_features: int = 0, least_count: float = 0.0, least_samples: int = 0) -> DataFrame:
    """``cells(sample_id, feature_id, value)`` of samples with enough non-zero features and counts, then of features that enough of these samples have."""
    some = F.count(F.when(F.col("value") != 0, 1))
    fine = cells.groupBy("sample_id").agg(some.alias("k"), F.sum("value").alias("c")).where((F.col("k") >= least_features) & (F.col("c") >= least_count)).select("sample_id")
    left = cells.join(fine, "sample_id", "left_semi")
    used = left.groupBy("feature_id").agg(some.alias("k")).where(F.col("k") >= least_samples).select("feature_id")
    return left.join(used, "feature_id", "left_semi").select("sample_id", "feature_id", "value")


def downsampled(cells: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """Counts of each sample thinned to about ``target``: each count stays with the same chance, by a hash of its number."""
    total = cells.groupBy("sample_id").agg(F.sum("value").alias("total"))
    at = cells.join(total, "sample_id").where("value > 0")
    units = at.select("sample_id", "feature_id", F.least(F.lit(1.0), F.lit(float(target)) / F.col("total")).alias("share"), F.explode(F.sequence(F.lit(1), F.col("value").cast("int"))).alias("unit"))
    kept = (F.pmod(F.xxhash64("sample_id", "feature_id", "unit", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))) < F.col("share")
    return units.where(kept).groupBy("sample_id", "feature_id").agg(F.count(F.lit(1)).cast("double").alias("value"))


def pca_baseline(rows: DataFrame, k: int, truth: DataFrame | None = None) -> DataFrame:
    """``(feature_id, value)``: variance left over when ``rows(id, x)`` are rebuilt from ``k`` components, over what there was.

    Axes and centre are those of ``rows``; with ``truth`` they are applied to
    these other rows.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    data = rows.select(array_to_vector(F.col("x").cast("array<double>")).alias("v"))
    mean = np.array(data.select(Summarizer.mean(F.col("v"))).first()[0].toArray())
    axes = PCA(k=k, inputCol="v", outputCol="p").fit(data).pc.toArray()
    held = rows.sparkSession.sparkContext.broadcast((mean, axes))

    def run(batches):
        centre, pc = held.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0)) - centre
                left = x - x @ pc @ pc.T
                n = np.arange(x.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array((left**2).sum(0)), pa.array((x**2).sum(0)), pa.array(x.sum(0)), pa.array(np.full(len(n), len(x)))], names=["feature_id", "sse", "sst", "s", "n"])

    got = (truth or rows).select(F.col("x").cast("array<double>").alias("x")).mapInArrow(run, "feature_id int, sse double, sst double, s double, n long")
    at = got.groupBy("feature_id").agg(*[F.sum(c).alias(c) for c in ("sse", "sst", "s", "n")])
    return at.select("feature_id", F.try_divide("sse", F.col("sst") - F.col("s") ** 2 / F.col("n")).alias("value"))


def silhouette(rows: DataFrame, labels: DataFrame) -> float:
    """Mean silhouette by squared Euclidean distance of ``rows(id, x)`` under ``labels(id, cluster_id)``; from sums by cluster, no pairs."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = rows.join(labels, "id").select(array_to_vector(F.col("x").cast("array<double>")).alias("features"), F.col("cluster_id").cast("double").alias("prediction"))
    return ClusteringEvaluator(metricName="silhouette").evaluate(data)


def contingency(a: DataFrame, b: DataFrame) -> np.ndarray:
    """Counts of two labelings ``(id, cluster_id)`` of the same ids; as many rows and columns as they have labels."""
    got = a.withColumnRenamed("cluster_id", "i").join(b.withColumnRenamed("cluster_id", "j"), "id").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).collect()
    rows, columns = sorted({r.i for r in got}), sorted({r.j for r in got})
    out = np.zeros((len(rows), len(columns)))
    for r in got:
        out[rows.index(r.i), columns.index(r.j)] = r.n
    return out


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log(p)).sum())


def mutual_information(table: np.ndarray) -> dict[str, float]:
    """Mutual information of a contingency table, normalised by the mean entropy, and adjusted for chance (hypergeometric expectation)."""
    from math import lgamma

    n = table.sum()
    a, b = table.sum(1), table.sum(0)
    h, g = _entropy(a), _entropy(b)
    mi = h + g - _entropy(table.ravel())
    log = np.array([lgamma(i + 1) for i in range(int(n) + 1)])
    expected = 0.0
    for x in a.astype(int):
        for y in b.astype(int):
            k = np.arange(max(1, x + y - int(n)), min(x, y) + 1)
            if len(k):
                p = log[x] + log[y] + log[int(n) - x] + log[int(n) - y] - log[int(n)] - log[k] - log[x - k] - log[y - k] - log[int(n) - x - y + k]
                expected += float((k / n * np.log(n * k / (x * y)) * np.exp(p)).sum())
    mean = (h + g) / 2
    return {"mi": mi, "nmi": mi / mean if mean else 1.0, "ami": (mi - expected) / (mean - expected) if abs(mean - expected) > 1e-12 else 1.0}


def best_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(i, j, jaccard)``: for each cluster of one labeling ``(id, cluster_id)`` the most alike cluster of another, the least number on ties."""
    x, y = a.withColumnRenamed("cluster_id", "i"), b.withColumnRenamed("cluster_id", "j")
    sizes = [t.groupBy(c).agg(F.count(F.lit(1)).alias(f"n_{c}")) for t, c in ((x, "i"), (y, "j"))]
    common = x.join(y, "id").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    at = common.join(F.broadcast(sizes[0]), "i").join(F.broadcast(sizes[1]), "j").withColumn("jaccard", F.col("n") / (F.col("n_i") + F.col("n_j") - F.col("n")))
    return at.groupBy("i").agg(F.max_by(F.struct("j", "jaccard"), F.struct("jaccard", -F.col("j"))).alias("best")).select("i", "best.j", "best.jaccard")


def batch_splits(batches: list[int]) -> list[tuple[list[int], list[int]]]:
    """All ways to halve the batches; a half and its complement count once."""
    first, *rest = sorted(batches)
    half = len(batches) // 2
    return [([first, *some], [b for b in rest if b not in some]) for some in combinations(rest, half - 1)]


def cross_validated(model: ForestModel, batch: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(split, cluster_id, fvu, other_fvu)``: unexplained variance of factors in either half of the batches, for every way to halve them.

    ``batch(sample_id, batch)``; the forest is derived for one half and judged on both.
    """
    names = sorted(r.batch for r in batch.select("batch").distinct().collect())
    out = None
    for i, (a, b) in enumerate(batch_splits(names)):
        halves = [model.samples.join(batch.where(F.col("batch").isin(some)), "sample_id", "left_semi") for some in (a, b)]
        part = factor_fvu(model, *halves, clusters).select(F.lit(i).alias("split"), "cluster_id", "fvu", "other_fvu")
        out = part if out is None else out.unionByName(part)
    return out


def negative_binomial(cells: DataFrame) -> DataFrame:
    """``(feature_id, p, r)`` by moments: p = mean / variance, r = mean * p / (1 - p); null unless the variance is larger."""
    at = cells.groupBy("feature_id").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    p = F.when(F.col("v") > F.col("m"), F.try_divide("m", "v"))
    return at.select("feature_id", p.alias("p"), F.try_divide(F.col("m") * p, 1 - p).alias("r"))


def poisson_distance(cells: DataFrame) -> DataFrame:
    """``(feature_id, ks)``: the largest distance of counts' distribution from the Poisson law of their mean."""
    counts = cells.groupBy("feature_id", F.col("value").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    whole = cells.groupBy("feature_id").agg(F.count(F.lit(1)).alias("all"), F.avg("value").alias("m"))
    rows = counts.join(whole, "feature_id").groupBy("feature_id", "all", "m").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("seen"))  # as many as there are different counts

    def law(k):
        terms = F.transform(F.sequence(F.lit(0), k), lambda i: F.exp(i * F.log(F.col("m")) - F.col("m") - F.aggregate(F.sequence(F.lit(0), i), F.lit(0.0), lambda a, j: a + F.when(j > 0, F.log(j.cast("double"))).otherwise(0.0))))
        return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)

    def gap(k):
        seen = F.aggregate(F.filter("seen", lambda s: s["k"] <= k), F.lit(0).cast("long"), lambda a, s: a + s["n"]) / F.col("all")
        return F.abs(seen - F.when(F.col("m") > 0, law(k)).otherwise(1.0))

    return rows.select("feature_id", F.array_max(F.transform(F.sequence(F.lit(0), F.array_max(F.transform("seen", lambda s: s["k"]))), gap)).alias("ks"))


def simulated(spark: SparkSession, n: int, loadings: list[list[tuple[float, float, float]]], factors: list[list[float]], noise: float = 0.1, seed: int = 0) -> DataFrame:
    """``(sample_id, x)``: factor scores times factors plus noise.

    ``loadings`` has for each factor its (from, to, score) over shares of the
    rows; a row outside has score 0. Normal noise is by Spark's seeded ``randn``
    on a fixed number of partitions, so reruns agree.
    """
    rows = spark.range(n, numPartitions=8).withColumnRenamed("id", "sample_id")
    share = F.col("sample_id") / F.lit(float(n))
    scores = []
    for parts in loadings:
        c = F.lit(0.0)
        for a, b, s in parts:
            c = F.when((share >= a) & (share < b), F.lit(float(s))).otherwise(c)
        scores.append(c)
    x = [sum((s * f[j] for s, f in zip(scores, factors, strict=True)), F.lit(0.0)) + F.lit(noise) * F.randn(seed + j) for j in range(len(factors[0]))]
    return rows.select("sample_id", F.array(*x).alias("x"))
