"""Queries that apply the operators as functions; their SQL twins are written by hand in ``twins``."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import linear_score, scaled_score, tsv
from ..operators import compare, evaluate, factors, neighbours, order, paths, reports, training
from ..operators.forest import Forest
from ..operators.model import ForestModel
from ..operators.prefixes import Prefixes
from ..operators.routing import matrix
from ..params import ForestParams
from ..sources import matrix as sources
from ..sources.matrix import cells, embeddings, unique_names
from .relations import Relations, fixture_relations

#: Parameters of the forest that the queries grow: B2 of the baseline with fewer trees.
GROWN = ForestParams(trees=8, depth=4, samples=200, in_features=20, out_features=20, seed=7)


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def _model(r: Relations) -> ForestModel:
    return ForestModel(r.forest, r.samples.select("sample_id", "x"))


def _grown(spark: SparkSession, sf: str) -> ForestModel:
    return ForestModel.fit(embeddings(spark, sf).select("sample_id", "x"), GROWN)


def _halves(r: Relations) -> tuple[DataFrame, DataFrame]:
    return tuple(r.samples.where(F.col("sample_id") % 2 == k).select("sample_id", "x") for k in (0, 1))


def _lists(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def prj_linear_score(spark, sf):
    s = embeddings(spark, sf)
    return s.select("sample_id", r6(linear_score(F.col("x"), _lists([0, 1, 2, 3]), _lists([0.5, -1.5, 2.0, 0.25]), _lists([0.1, -0.2, 0.0, 0.05]))).alias("score"))


def prj_scaled_score(spark, sf):
    s = embeddings(spark, sf)
    return s.select("sample_id", r6(scaled_score(F.col("x"), _lists([0, 1]), _lists([0.5, -1.5]), _lists([0.1, -0.2]))).alias("score"))


def win_valsort(spark, sf):
    return order.row_numbers(cells(embeddings(spark, sf)), ["feature_id"], "value", "sample_id").select("feature_id", "sample_id", "p")


def _signed(spark, sf):
    return cells(embeddings(spark, sf)).withColumn("other", (F.col("sample_id") % 2).cast("int"))


def cmp_rank_sum(spark, sf):
    return order.rank_sum(_signed(spark, sf), ["feature_id"], "value", "other").select("feature_id", r6("rank_sum").alias("rank_sum"), r6("u").alias("u"))


def cmp_ks(spark, sf):
    return order.kolmogorov_smirnov(_signed(spark, sf), ["feature_id"], "value", "other").select("feature_id", r6("ks").alias("ks"))


def agg_jackknife(spark, sf):
    return order.jackknife(cells(embeddings(spark, sf)), ["feature_id"], F.col("value") ** 2).select("feature_id", r6("variance").alias("value"))


def agg_feature_median(spark, sf):
    return order.medians(cells(embeddings(spark, sf)), ["feature_id"], "value").select("feature_id", r6("median").alias("value"))


def prd_mean(spark, sf):
    r = fixture_relations(spark, sf)
    p = _model(r).predict(r.samples).predicted("mean")
    return p.select("sample_id", F.posexplode("predicted").alias("feature_id", "p")).select("sample_id", "feature_id", r6("p").alias("predicted"))


def prd_additive(spark, sf):
    r = fixture_relations(spark, sf)
    p = _model(r).predict(r.samples).predicted("additive_mean")
    return p.select("sample_id", F.posexplode("predicted").alias("feature_id", "p")).select("sample_id", "feature_id", r6("p").alias("predicted"))


def prd_residuals(spark, sf):
    r = fixture_relations(spark, sf)
    return _model(r).predict(r.samples).residuals(mode="mean").select("sample_id", "feature_id", r6("residual").alias("residual"), r6("null_residual").alias("null_residual"))


def _report(spark, sf, which, key):
    r = fixture_relations(spark, sf)
    out = _model(r).predict(r.samples).report(mode="mean")[which]
    return out.select(r6("fvu").alias("fvu")) if key is None else out.select(key, r6("fvu").alias("value"))


def met_report_total(spark, sf):
    return _report(spark, sf, "total", None)


def met_report_feature(spark, sf):
    return _report(spark, sf, "feature", "feature_id")


def met_report_sample(spark, sf):
    return _report(spark, sf, "sample", "sample_id")


def met_jackknife_var(spark, sf):
    r = fixture_relations(spark, sf)
    return order.jackknife(_model(r).predict(r.samples).residuals(mode="mean"), ["feature_id"], F.col("residual") ** 2).select("feature_id", r6("variance").alias("value"))


def _node_rows(r: Relations) -> DataFrame:
    return factors.vectors(factors.node_representation(_model(r), "mean"), 64)


def knn_exact(spark, sf):
    return neighbours.knn(_node_rows(fixture_relations(spark, sf)), 5, "euclidean").select("a", "b", "place")


def knn_double(spark, sf):
    r = fixture_relations(spark, sf)
    own = factors.overlaps(r.forest, r.samples).withColumnRenamed("x", "x2")
    return neighbours.knn(_node_rows(r).join(own, "id"), 5, "cosine", "overlap").select("a", "b", "place")


def knn_samples(spark, sf):
    return neighbours.knn(embeddings(spark, sf).select(F.col("sample_id").alias("id"), "x"), 10, "cosine").select("a", "b", "place")


def con_transitions(spark, sf):
    r = fixture_relations(spark, sf)
    return factors.transitions(r.forest, r.clusters)


def con_likely_tree(spark, sf):
    r = fixture_relations(spark, sf)
    tree = factors.likely_tree(factors.square(factors.transitions(r.forest, r.clusters)))
    return factors.tree_table(spark, tree).select("cluster_id", "depth")


def con_spanning_tree(spark, sf):
    r = fixture_relations(spark, sf)
    return factors.tree_table(spark, factors.spanning_tree(factors.square(factors.affinity(_model(r), r.clusters, "samples"))))


def con_partial_dependence(spark, sf):
    r = fixture_relations(spark, sf)
    m = factors.partial_dependence(r.forest, r.clusters)
    return spark.createDataFrame([(i, j, round(float(v), 6)) for i, row in enumerate(m) for j, v in enumerate(row)], "cluster_a int, cluster_b int, value double")


def con_affinity_means(spark, sf):
    r = fixture_relations(spark, sf)
    return factors.affinity(_model(r), r.clusters, "means").select("parent", "child", r6("value").alias("value"))


def con_layout(spark, sf):
    r = fixture_relations(spark, sf)
    tree = factors.likely_tree(factors.square(factors.transitions(r.forest, r.clusters)))
    width = {x.cluster_id: x.w for x in r.clusters.join(_model(r).node_features(), "node_id").where("feature_id = 0").groupBy("cluster_id").agg(F.avg("n").alias("w")).collect()}
    return spark.createDataFrame(factors.layout(tree, width), "cluster_id int, x double, depth int, width double")


def trv_child_clusters(spark, sf):
    r = fixture_relations(spark, sf)
    return factors.child_clusters(r.forest, r.clusters)


def _changes(against, log=False):
    def run(spark, sf):
        r = fixture_relations(spark, sf)
        return factors.changes(_model(r), r.clusters, against, log).select("cluster_id", "feature_id", r6("value").alias("value"))

    return run


def fac_important_features(spark, sf):
    r = fixture_relations(spark, sf)
    return factors.important_features(_model(r), r.clusters, 3)


def fac_strict_error(spark, sf):
    r = fixture_relations(spark, sf)
    return factors.strict_errors(_model(r), r.clusters)[0].select("cluster_id", "feature_id", r6("value").alias("value"))


def fac_strict_fraction(spark, sf):
    r = fixture_relations(spark, sf)
    return factors.strict_errors(_model(r), r.clusters)[1].select("cluster_id", r6("fvu").alias("fvu"))


def fac_parent_scores(spark, sf):
    r = fixture_relations(spark, sf)
    return factors.scores(_model(r), r.clusters).where("parent > 0").select("cluster_id", "sample_id", r6("parent_score").alias("score"))


def fac_enrichment(spark, sf):
    r = fixture_relations(spark, sf)
    return factors.enrichment(r.forest, r.clusters).select("cluster_id", "downstream", r6("value").alias("value"))


def fac_most_local(spark, sf):
    r = fixture_relations(spark, sf)
    return factors.most_local(_model(r), r.clusters, list(range(10)), 5).select("cluster_id", "feature_a", "feature_b", r6("delta").alias("delta"))


def fac_regression(spark, sf):
    r = fixture_relations(spark, sf)
    return factors.regressions(_model(r), r.clusters).select("cluster_id", "target", "input", r6("coefficient").alias("coefficient"))


def fac_top_split_features(spark, sf):
    r = fixture_relations(spark, sf)
    return factors.top_split_features(_model(r), r.clusters, 3).select("cluster_id", "feature_id", "place")


def fac_logistic_change(spark, sf):
    r = fixture_relations(spark, sf)
    return factors.logistic_change(_model(r), r.clusters, 1).select("feature_id", "place")


def smp_logistic(spark, sf):
    r = fixture_relations(spark, sf)
    return factors.sample_logistic(_model(r), r.samples.select("sample_id", F.col("label").alias("cluster_id")), 2).select("feature_id", "place")


def cmp_fraction_mwu(spark, sf):
    r = fixture_relations(spark, sf)
    return compare.factor_fractions(_model(r), *_halves(r), r.clusters).select("cluster_id", r6("u").alias("u"))


def cmp_factor_fvu(spark, sf):
    r = fixture_relations(spark, sf)
    own, other = _halves(r)
    return compare.factor_fvu(_model(r), own, other, r.clusters).select("cluster_id", r6("fvu").alias("fvu"), r6("other_fvu").alias("other_fvu"), r6("u").alias("u"))


def cmp_factor_residuals(spark, sf):
    r = fixture_relations(spark, sf)
    return compare.factor_residuals(_model(r), *_halves(r), r.clusters).select("cluster_id", r6("delta").alias("delta"), F.round("z", 3).alias("z"))


def cmp_factor_means_rank(spark, sf):
    r = fixture_relations(spark, sf)
    return compare.factor_means(_model(r), _halves(r)[1], r.clusters).select("cluster_id", r6("other_distance").alias("other_distance"), "rank", "nodes")


def cmp_factor_marginals(spark, sf):
    r = fixture_relations(spark, sf)
    return compare.factor_marginals(_model(r), *_halves(r), r.clusters).select("cluster_id", r6("own_distance").alias("own_distance"), r6("other_distance").alias("other_distance"))


def cmp_all_factors(spark, sf):
    r = fixture_relations(spark, sf)
    return compare.compare_factors(_model(r), *_halves(r), r.clusters)


def enc_weight(spark, sf):
    return factors.node_representation(_model(fixture_relations(spark, sf)), "weight").select("node_id", F.col("dim").alias("feature_id"), "value")


def _representation(mode):
    def run(spark, sf):
        return factors.node_representation(_model(fixture_relations(spark, sf)), mode).select("node_id", F.col("dim").alias("feature_id"), r6("value").alias("value"))

    return run


def enc_principal(spark, sf):
    return factors.principal(_node_rows(fixture_relations(spark, sf)), 3).select(F.col("id").alias("node_id"), "x")


def _counts(spark, sf):
    """The matrix as counts: twenty times its absolute values, rounded down."""
    return cells(embeddings(spark, sf)).select("sample_id", "feature_id", F.floor(F.abs("value") * 20).cast("double").alias("value"))


def nb_negative_binomial(spark, sf):
    return evaluate.negative_binomial(_counts(spark, sf)).select("feature_id", r6("p").alias("p"), r6("r").alias("r"))


def nb_poisson_ks(spark, sf):
    return evaluate.poisson_distance(_counts(spark, sf)).select("feature_id", r6("ks").alias("ks"))


def pre_filtered(spark, sf):
    return evaluate.filtered(_counts(spark, sf), 55, 90.0, 400)


def pre_downsampled(spark, sf):
    return evaluate.downsampled(_counts(spark, sf), 60, 7)


def nb_pca_baseline(spark, sf):
    return evaluate.pca_baseline(embeddings(spark, sf).select(F.col("sample_id").alias("id"), "x"), 25).select("feature_id", r6("value").alias("value"))


def nb_silhouette(spark, sf):
    s = embeddings(spark, sf)
    value = evaluate.silhouette(s.select(F.col("sample_id").alias("id"), "x"), s.select(F.col("sample_id").alias("id"), F.col("label").alias("cluster_id")))
    return spark.createDataFrame([(round(value, 6),)], "value double")


def nb_jaccard_runs(spark, sf):
    s = embeddings(spark, sf)
    side = F.when(F.element_at("x", 1) > 0, 1).otherwise(0)
    a, b = s.select(F.col("sample_id").alias("id"), F.col("label").alias("cluster_id")), s.select(F.col("sample_id").alias("id"), side.alias("cluster_id"))
    return evaluate.best_jaccard(a, b).select("i", "j", r6("jaccard").alias("jaccard"))


def nb_mutual_information(spark, sf):
    s = embeddings(spark, sf)
    a = s.select(F.col("sample_id").alias("id"), F.col("label").alias("cluster_id"))
    b = s.select(F.col("sample_id").alias("id"), F.when(F.element_at("x", 1) > 0, 1).otherwise(0).alias("cluster_id"))
    got = evaluate.mutual_information(evaluate.contingency(a, b))
    return spark.createDataFrame([(round(got["mi"], 6), round(got["nmi"], 6), round(got["ami"], 6))], "mi double, nmi double, ami double")


def nb_cross_validation(spark, sf):
    r = fixture_relations(spark, sf)
    return evaluate.cross_validated(_model(r), r.samples.select("sample_id", (F.col("sample_id") % 4).alias("batch")), r.clusters).select("split", "cluster_id", r6("fvu").alias("fvu"), r6("other_fvu").alias("other_fvu"))


def nb_simulated(spark, sf):
    return evaluate.simulated(spark, 10_000, [[(0, 1, 2)], [(0.5, 0.75, 1)], [(0.75, 1, 1)]], [[2, 0, 0], [0, 1, 0], [0, 0, 1]])


def src_auto_parameters(spark, sf):
    s = embeddings(spark, sf)
    n, width = s.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    p = ForestParams().auto(n, width)
    return spark.createDataFrame([(p.in_features, p.samples)], "features long, draws long")


def src_header(spark, sf):
    names = cells(embeddings(spark, sf)).select("feature_id").distinct()
    return unique_names(names.select("feature_id", F.concat(F.lit("g"), (F.col("feature_id") % 7).cast("string")).alias("raw")))


def snk_tsv(spark, sf):
    return embeddings(spark, sf).select("sample_id", tsv(F.col("sample_id"), F.col("label")).alias("line"))


# ---- order statistics of whole columns, and training


#: Statistics of the values before or after each place; tasks that columns are spread over; cells that a batch of them holds, about.
SUFFIX, COLUMN_TASKS, COLUMN_CELLS = ("right_median", "left_median", "right_mean", "right_sme", "right_ssme", "right_variance", "right_mad"), 64, 1_000_000
#: Of so many columns that follow each other, so many have tasks of their own; the others join them and share the order of rows.
COLUMN_SPAN, COLUMN_GROUPS = 64, 32


def rounded(v: np.ndarray, digits: int) -> np.ndarray:
    """Halves go away from 0, as in SQL; what is too large to have such decimals stays."""
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.abs(v) * 10.0**digits
        whole = np.trunc(scaled)
        whole += scaled - whole >= 0.5
        return np.where(scaled < 2.0**52, np.copysign(whole / 10.0**digits, v), v) + 0.0


def _of_column(rest: np.ndarray, wanted: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Order statistics of one target column in the order of the first column."""
    n = len(rest)
    gone = rest[::-1]
    centred = gone - np.median(gone)  # sums lose no places to a far off column
    sums = Prefixes(centred, sums=True) if "right_sme" in wanted else None
    left = Prefixes(rest) if "left_median" in wanted else None
    right = Prefixes(gone) if {"right_median", "right_mad"} & set(wanted) else None
    count, s, q = np.arange(1, n + 1), np.cumsum(centred), np.cumsum(centred**2)

    def by_size(column):  # of all values that are left, for what was a prefix by its size
        if column == "right_median":
            return right.medians()
        if column == "right_mad":
            return right.deviations()
        if column == "right_mean":
            return np.append(np.nan, np.cumsum(gone) / count)
        if column == "right_sme":
            return sums.absolute(centred)
        if column == "right_variance":
            return np.append(0.0, np.maximum(0, q / count - (s / count) ** 2))
        m = (sums or Prefixes(centred)).medians()[1:]
        return np.append(0.0, np.maximum(0, q - 2 * m * s + count * m**2))

    return {c: left.medians()[:n] if c == "left_median" else by_size(c)[:n][::-1] for c in wanted}


def _suffix(wanted: tuple[str, ...], digits: int | None):
    """Order statistics of the columns of a group, which share the order of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ids, x, y = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("sample_id", "x", "y"))
        sizes = np.array([len(part) for part in table["sample_id"]])
        columns = table["columns"].to_pylist()
        at = np.lexsort((ids, x))
        del table, ids, x  # only the values and their order are kept while columns go out
        starts = np.cumsum([0, *(len(c) * n for c, n in zip(columns, sizes))])
        for f in sorted({f for c in columns for f in c}):
            there = [f in c for c in columns]
            rest = np.concatenate([y[(lo := start + c.index(f) * n) : lo + n] if f in c else np.zeros(n) for c, start, n in zip(columns, starts, sizes)])[at]
            if not all(there):
                rest = rest[np.repeat(there, sizes)[at]]
            n = len(rest)
            cols = _of_column(rest, wanted)
            if digits is not None:
                cols = {c: rounded(v, digits) for c, v in cols.items()}
            yield pa.RecordBatch.from_pydict({"feature_id": pa.array(np.full(n, f, np.int32)), "p": pa.array(np.arange(n)), **{k: pa.array(v, pa.float64(), from_pandas=True) for k, v in cols.items()}})

    return run


def _turned(by: int):
    """Columns of batches of rows by groups: ``(part, columns, sample_id, x, y)``, lists over the rows, ``x`` the column ``by``, ``y`` the columns one after the other."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for width in np.unique(sizes[sizes > 0]).tolist():
                some = batch.filter(pa.array(sizes == width))
                step = max(1, COLUMN_CELLS // width)
                part_of = np.arange(width) // COLUMN_SPAN * COLUMN_GROUPS + np.arange(width) % COLUMN_GROUPS
                parts, found = np.unique(part_of, return_counts=True)
                turn = np.argsort(part_of, kind="stable")
                ends = np.append(0, np.cumsum(found)).astype(np.int32)
                for lo in range(0, some.num_rows, step):
                    rows = some.slice(lo, step)
                    v = matrix(rows.column(1))
                    n = len(v)
                    bounds = pa.array(np.arange(len(parts) + 1, dtype=np.int32) * n)
                    keys = [pa.ListArray.from_arrays(bounds, c) for c in (pa.concat_arrays([rows.column(0)] * len(parts)), pa.array(np.tile(v[:, by], len(parts))))]
                    columns = pa.ListArray.from_arrays(pa.array(ends), pa.array(turn.astype(np.int32)))
                    y = pa.ListArray.from_arrays(pa.array(ends * n), pa.array(v.T[turn].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), columns, *keys, y], names=["part", "columns", "sample_id", "x", "y"])

    return run


def suffix_statistics(samples: DataFrame, by: int = 0, wanted: tuple[str, ...] = SUFFIX, digits: int | None = None) -> DataFrame:
    """``(feature_id, p, right_median, left_median, right_mean, right_sme, right_ssme, right_variance, right_mad)``, or of these statistics the ``wanted``.

    For every column the statistics of the values after (``right``) and before
    (``left``) each place p, when rows are in the order of column ``by``. Each
    place depends on all values on its side, so a column is one task's work;
    that grows like n log n, for ``right_mad`` n log² n. With ``digits`` they
    are rounded to so many decimals; Spark's own rounding goes through a
    decimal for each row and takes longer than all else.
    """
    rows = samples.select("sample_id", F.col("x").cast("array<double>").alias("x")).where("x is not null")
    kind = rows.schema["sample_id"].dataType.simpleString()
    turned = rows.mapInArrow(_turned(by), f"part int, columns array<int>, sample_id array<{kind}>, x array<double>, y array<double>")
    spread = turned.repartition(COLUMN_TASKS, "part")  # a number of its own: few bytes are much work
    return spread.groupBy("part").applyInArrow(_suffix(wanted, digits), "feature_id int, p long, " + ", ".join(f"{c} double" for c in wanted))


def _suffix_query(column):
    def run(spark, sf):
        value = F.col(column)
        if column not in ("right_median", "left_median", "right_mean", "right_mad"):
            value = F.coalesce(value, F.lit(0.0))
        elif column == "right_mad":  # nothing on that side
            value = F.when(F.col("right_median").isNotNull(), value)
        wanted = (column, "right_median") if column == "right_mad" else (column,)
        return suffix_statistics(embeddings(spark, sf).select("sample_id", "x"), wanted=wanted, digits=6).select("feature_id", "p", value.alias("value"))

    return run


def _scored(kind: str):
    """Split scores of each tree's draw, over all inputs, for the drawn targets."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("draw")
        t = table["tree_id"][0].as_py()
        x = matrix(table["x"].combine_chunks())
        targets = np.array(table["targets"][0].as_py())
        scores, orders = training.split_scores(x, x[:, targets], 1, 0.5, "sme")
        ids = table["sample_id"].to_numpy()
        n, inputs = len(x), x.shape[1]
        if kind == "best":
            i, row, score, _ = training.best_split(x, x[:, targets], 1, 0.5, "sme")
            return pa.table({"tree_id": pa.array([t], pa.int32()), "feature_id": pa.array([i], pa.int32()), "sample_id": pa.array([ids[row]]), "threshold": pa.array([float(x[row, i])]), "score": pa.array([score])})
        return pa.table({"tree_id": pa.array([t] * (n * inputs), pa.int32()), "feature_id": pa.array(np.repeat(np.arange(inputs, dtype=np.int32), n)), "p": pa.array(np.tile(np.arange(n), inputs)), "sample_id": pa.array(ids[orders.ravel()]), "score": pa.array(scores.ravel())})

    return run


def _drawn(spark, sf) -> DataFrame:
    r = fixture_relations(spark, sf)
    draw = r.sql("SELECT tree_id, draw, sample_id FROM {draw}")
    targets = r.sql("SELECT t.tree_id, {hex8('7|out|', t.tree_id, '|', g.draw)} % 64 AS f FROM (SELECT DISTINCT tree_id FROM {node}) t CROSS JOIN {draws} g WHERE g.draw < 8")
    targets = targets.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.col("f").cast("int"))).alias("targets"))
    return draw.join(r.samples.select("sample_id", "x"), "sample_id").join(F.broadcast(targets), "tree_id")


def trn_split_scores(spark, sf):
    return _drawn(spark, sf).groupBy("tree_id").applyInArrow(_scored("all"), "tree_id int, feature_id int, p long, sample_id long, score double")


def trn_best_split(spark, sf):
    return _drawn(spark, sf).groupBy("tree_id").applyInArrow(_scored("best"), "tree_id int, feature_id int, sample_id long, threshold double, score double")


def trn_grown_nodes(spark, sf):
    return _grown(spark, sf).forest.nodes


def trn_grown_populations(spark, sf):
    m = _grown(spark, sf)
    return m.node_features().where("feature_id = 0").select("node_id", "n", r6("mean").alias("mean"))


def trn_grown_report(spark, sf):
    m = _grown(spark, sf)
    return m.predict(m.samples).report()["feature"].select("feature_id", r6("fvu").alias("fvu"))


def trn_reduced_nodes(spark, sf):
    p = replace(GROWN, trees=3, depth=3, reduce_input=True, reduce_output=True)
    return ForestModel.fit(embeddings(spark, sf).select("sample_id", "x"), p).forest.nodes


def clu_interpret_splits(spark, sf):
    return factors.interpret_splits(_grown(spark, sf), k=5)


def clu_samples(spark, sf):
    return neighbours.cluster_rows(embeddings(spark, sf).select(F.col("sample_id").alias("id"), "x"), 10, "cosine")


def clu_samples_by_leaves(spark, sf):
    m = _grown(spark, sf)
    leaf = m.forest.nodes.where("is_leaf").select("node_id")
    long = m.forest.members(m.samples).join(F.broadcast(leaf), "node_id").select(F.col("sample_id").alias("node_id"), F.col("node_id").alias("dim"), F.lit(1.0).alias("value"))
    found = neighbours.cluster_rows(factors.vectors(long, len(m.forest.rows)), 10, "jaccard")
    return found.select(F.col("id").alias("sample_id"), (F.col("cluster_id") + 1).alias("cluster_id"))


def clu_leaves(spark, sf):
    m = _grown(spark, sf)
    rows = factors.vectors(factors.node_representation(m, "mean"), m.width)
    return neighbours.cluster_rows(rows.join(m.forest.nodes.where("is_leaf").select(F.col("node_id").alias("id")), "id", "left_semi"), 5, "cosine")


def trv_path_vectors(spark, sf):
    return paths.path_vectors(fixture_relations(spark, sf).forest).select("node_id", F.array_join(F.transform("path", lambda n: n.cast("string")), "/").alias("path"))


def trv_consensus_levels(spark, sf):
    r = fixture_relations(spark, sf)
    return paths.consensus_levels(r.forest, r.clusters).select("cluster_id", "level", "ancestor_id", r6("share").alias("share"))


def trv_sorted_nodes(spark, sf):
    r = fixture_relations(spark, sf)
    return paths.sorted_nodes(r.forest, r.samples).select("node_id", "sample_id", "place")


def enc_path(spark, sf):
    """Clusters by nodes, 0 or 1."""
    r = fixture_relations(spark, sf)
    every = r.clusters.select("cluster_id").distinct().crossJoin(F.broadcast(r.forest.nodes.select("node_id")))  # clusters times nodes, both bounded by the forest
    return every.join(r.clusters.withColumn("value", F.lit(1)), ["cluster_id", "node_id"], "left").select("cluster_id", "node_id", F.coalesce("value", F.lit(0)).alias("value"))


def enc_biclustered(spark, sf):
    r = fixture_relations(spark, sf)
    rows = _node_rows(r).orderBy("id").collect()  # one a node
    nodes, features = paths.biclustered(np.array([x.x for x in rows]))
    return spark.createDataFrame([("node", p, int(rows[i].id)) for p, i in enumerate(nodes)] + [("feature", p, int(i)) for p, i in enumerate(features)], "kind string, place long, id long")


# ---- sources and sinks, written and read again


def _folder(spark: SparkSession) -> str:
    """A new folder where the cluster shares files; a temporary one in local sessions that name none."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="silvaframe-")
        atexit.register(shutil.rmtree, found, True)
    path = f"{found.rstrip('/')}/source-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def src_matrix_text(spark, sf):
    path = _folder(spark)
    sources.write_matrix(embeddings(spark, sf), path)
    return cells(sources.read_matrix(spark, f"{path}/*.txt")).select("sample_id", "feature_id", r6("value").alias("value"))


def src_triples(spark, sf):
    path = _folder(spark)
    c = cells(embeddings(spark, sf)).where("value > 0")
    c.select(F.col("sample_id") + 1, F.col("feature_id") + 1, "value").write.csv(path, sep=" ")
    return sources.read_triples(spark, path, least_sample=2.5).select("sample_id", "feature_id", r6("value").alias("value"))


def src_mtx(spark, sf):
    path = _folder(spark)
    c = cells(embeddings(spark, sf)).where("value > 0").select(F.concat_ws(" ", (F.col("sample_id") + 1).cast("string"), (F.col("feature_id") + 1).cast("string"), F.col("value").cast("string")).alias("value"))
    spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), ("0 0 0",)], "value string").coalesce(1).write.text(f"{path}/a")
    c.write.text(f"{path}/b")
    return sources.read_mtx(spark, f"{path}/*/*.txt").select("sample_id", "feature_id", r6("value").alias("value"))


def src_header_file(spark, sf):
    path = _folder(spark)
    sources.write_names(spark, [f'"g{i % 7}"' for i in range(64)], path)
    return sources.read_header(spark, f"{path}/*.txt").select(F.col("feature_id").cast("int").alias("feature_id"), "name")


def src_node_labels(spark, sf):
    r = fixture_relations(spark, sf)
    path = _folder(spark)
    label = {x.node_id: x.cluster_id for x in r.clusters.collect()}
    sources.write_names(spark, [str(label.get(i, "")) for i in range(len(r.forest.rows))], path)
    return sources.read_labels(spark, f"{path}/*.txt")


def snk_tree_json(spark, sf):
    """The fixture forest as JSON files, read again: nodes with their tests."""
    r = fixture_relations(spark, sf)
    path = _folder(spark)
    sources.write_trees(r.forest, r.samples, path)
    back = Forest(spark, sources.read_trees(spark, f"{path}/*/*.txt"))
    return back.nodes.select("node_id", "tree_id", "parent_id", "level", "lr", F.get("features", F.lit(0)).alias("feature"))


def snk_tree_samples(spark, sf):
    """Samples of each node of the tree files."""
    r = fixture_relations(spark, sf)
    path = _folder(spark)
    sources.write_trees(r.forest, r.samples, path)
    got = sources.tree_samples(spark, f"{path}/*/*.txt")
    tree = F.regexp_extract("tree", r"tree_id=(\d+)", 1).cast("long")
    return got.select((tree * 7 + F.col("node_id")).alias("node_id"), "sample_id")


def snk_backup(spark, sf):
    """A model stored and restored: its mean prediction."""
    r = fixture_relations(spark, sf)
    path = _folder(spark)
    _model(r).backup(path)
    m = ForestModel.restore(spark, path)
    return m.predict(m.samples).predicted("mean").select("sample_id", F.posexplode("predicted").alias("feature_id", "p")).select("sample_id", "feature_id", r6("p").alias("predicted"))


def snk_cluster_json(spark, sf):
    """The summary of each cluster as JSON."""
    r = fixture_relations(spark, sf)
    about = reports.cluster_summary(_model(r), r.clusters, 5)
    return spark.createDataFrame([(c, json.dumps(a, sort_keys=True)) for c, a in sorted(about.items())], "cluster_id int, summary string")


def snk_pages(spark, sf):
    """The HTML pages of the clusters and the consensus tree."""
    r = fixture_relations(spark, sf)
    about = reports.cluster_summary(_model(r), r.clusters, 5)
    tree = factors.spanning_tree(factors.square(factors.affinity(_model(r), r.clusters)))
    pages = {f"cluster-{c}": reports.cluster_page(c, a) for c, a in about.items()} | {"tree": reports.tree_page(tree, about)}
    return spark.createDataFrame(sorted(pages.items()), "name string, page string")


def prd_out_of_bag(spark, sf):
    s = embeddings(spark, sf).select("sample_id", "x")
    held = F.pmod(F.xxhash64("sample_id", F.lit(GROWN.seed)), F.lit(5)) == 0
    m = ForestModel.fit(s.where(~held), GROWN)
    return m.out_of_bag(s).select("sample_id", F.posexplode("predicted").alias("feature_id", "p")).select("sample_id", "feature_id", r6("p").alias("predicted"))


QUERIES = {f.__name__: f for f in (
    prj_linear_score, prj_scaled_score, win_valsort, cmp_rank_sum, cmp_ks, agg_jackknife, agg_feature_median, prd_mean, prd_additive, prd_residuals,
    met_report_total, met_report_feature, met_report_sample, met_jackknife_var, knn_exact, knn_double, knn_samples, con_transitions, con_likely_tree,
    con_spanning_tree, con_partial_dependence, con_affinity_means, con_layout, trv_child_clusters, fac_important_features, fac_strict_error,
    fac_strict_fraction, fac_parent_scores, fac_enrichment, fac_most_local, fac_regression, fac_top_split_features, fac_logistic_change, smp_logistic,
    cmp_fraction_mwu, cmp_factor_fvu, cmp_factor_residuals, cmp_factor_means_rank, cmp_factor_marginals, cmp_all_factors, enc_weight, enc_principal,
    nb_negative_binomial, nb_poisson_ks, pre_filtered, pre_downsampled, nb_pca_baseline, nb_silhouette, nb_jaccard_runs, nb_mutual_information,
    nb_cross_validation, nb_simulated, src_auto_parameters, src_header, snk_tsv, trn_split_scores, trn_best_split, trn_grown_nodes,
    trn_grown_populations, trn_grown_report, trn_reduced_nodes, clu_interpret_splits, clu_samples, clu_samples_by_leaves, clu_leaves, prd_out_of_bag, trv_path_vectors, trv_consensus_levels, trv_sorted_nodes, enc_path, enc_biclustered, src_matrix_text, src_triples,
    src_mtx, src_header_file, src_node_labels, snk_tree_json, snk_tree_samples, snk_backup, snk_cluster_json, snk_pages,
)}
QUERIES |= {f"fac_change_{k}": _changes(*a) for k, a in {"abs": ("parent",), "sister": ("sister",), "root": ("root",), "log2": ("parent", True), "log2_sister": ("sister", True), "log2_root": ("root", True)}.items()}
QUERIES |= {f"enc_{k}": _representation(k) for k in ("gain", "error_ratio", "partial", "additive")}
QUERIES |= {f"win_{k}": _suffix_query(c) for k, c in {"suffix_median": "right_median", "prefix_median": "left_median", "suffix_sme": "right_sme", "suffix_ssme": "right_ssme", "suffix_variance": "right_variance", "suffix_mean": "right_mean", "suffix_mad": "right_mad"}.items()}
