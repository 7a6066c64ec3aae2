"""Operators on grown forests and any matrix, against brute force."""

import json
import math
import time
from bisect import insort
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from silvaframe import streaming
from silvaframe.operators import compare, evaluate, factors, model, neighbours, order, reports, training
from silvaframe.operators.forest import Forest, Split, fixture
from silvaframe.operators.prefixes import Prefixes
from silvaframe.operators.routing import Router, groups
from silvaframe.params import ForestParams
from silvaframe.sources import matrix

PARAMS = ForestParams(trees=4, depth=3, samples=60, in_features=5, out_features=5, norm=1, seed=3)


@pytest.fixture(scope="module")
def samples(spark, sf):
    return matrix.embeddings(spark, sf).select("sample_id", F.slice("x", 1, 8).alias("x"), "label").persist()


@pytest.fixture(scope="module")
def x(samples):
    return np.array([r.x for r in samples.orderBy("sample_id").collect()])


@pytest.fixture(scope="module")
def grown(samples):
    return model.ForestModel.fit(samples.select("sample_id", "x"), PARAMS)


@pytest.fixture(scope="module")
def clusters(spark, grown):
    c = factors.interpret_splits(grown, k=3)
    return spark.createDataFrame(c.collect(), c.schema)


def members(forest, x):
    """Node id -> rows, by walking each tree."""
    out = {}

    def walk(node, number, rows):
        out[number[id(node)]] = rows
        if node.left is not None:
            score = sum(((x[rows, f] - m) * s for f, s, m in zip(node.features, node.scores, node.means, strict=True)), np.zeros(len(rows)))
            walk(node.left, number, rows[score <= node.split])
            walk(node.right, number, rows[score > node.split])

    for tree, number in zip(forest.trees, forest.numbers, strict=True):
        walk(tree, number, np.arange(len(x)))
    return out


# ---- training


@pytest.mark.parametrize("kind", ["sme", "ssme", "variance", "mad"])
def test_dispersion_of_what_is_left(kind):
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 8, 25):
        y, at = np.round(rng.standard_normal((n, 3)), 1), rng.permutation(n)
        d = training.left_dispersion(at, y, kind)
        for p in range(n):
            for k, v in enumerate(y[at][p:].T):
                m = np.median(v)
                want = {"sme": np.abs(v - m).sum(), "ssme": ((v - m) ** 2).sum(), "variance": v.var(), "mad": np.median(np.abs(v - m))}[kind]
                assert abs(d[p, k] - want) < 1e-9
        assert not d[n].any()


@pytest.mark.parametrize(("norm", "balance"), [(1, 0.0), (2, 0.5)])
def test_split_scores_against_brute_force(norm, balance):
    rng = np.random.default_rng(1)
    v, y = rng.standard_normal((30, 3)), rng.standard_normal((30, 2))
    scores, orders = training.split_scores(v, y, norm, balance)
    want = np.empty_like(scores)
    for i in range(3):
        o = np.argsort(v[:, i], kind="stable")
        assert (orders[i] == o).all()
        for p in range(30):
            sides = [(o[p + 1 :], (30 - p) / 30), (o[:p], (p + 1) / 30)]
            want[i, p] = sum(share**balance * sum(np.abs(c - np.median(c)).sum() ** norm for c in y[rows].T) for rows, share in sides if len(rows))
    assert np.abs(scores - want).max() < 1e-9
    i, row, score, _ = training.best_split(v, y, norm, balance)
    assert score == pytest.approx(want[:, 2:29].min()) and orders[i].tolist().index(row) in range(2, 29)


def test_draws_are_searched_together():
    rng = np.random.default_rng(11)
    some = [(rng.standard_normal((n, 3)), rng.standard_normal((n, 2))) for n in (20, 20, 9, 20, 4)]
    assert training.best_splits(some, 1, 0.5) == [training.best_split(*d, 1, 0.5) for d in some]
    assert training.best_splits(some, 1, 0.5)[4] is None


def test_golden_split(samples, spark, sf):
    v = np.array([r.x for r in matrix.embeddings(spark, sf).where("sample_id < 60").orderBy("sample_id").collect()])
    i, row, score, _ = training.best_split(v[:, :1], v[:, 1:3], 1, 0.0)
    assert (i, row) == (0, 45) and abs(score - 10.044735723757185) < 1e-9


def test_order_statistics_example():
    y = np.array([10.0, -3, 0, 5, -2, -1, 15, 20])[:, None]
    assert training.left_dispersion(np.arange(8), y, "sme")[:2, 0].tolist() == [56, 46]
    assert training.left_dispersion(np.arange(8), y, "ssme")[:2, 0].tolist() == [594, 664]


def test_components_are_principal():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((80, 5)) * [5, 3, 1, 0.5, 0.1]
    scores, loadings, mean = training.components(v, 2)
    _, _, axes = np.linalg.svd(v - v.mean(0))
    assert np.abs(np.abs(scores @ axes[:2].T) - np.eye(2)).max() < 0.02
    assert np.abs(loadings[:, 0] - (v - mean) @ scores[0]).max() < 1e-9
    assert len(training.components(np.ones((4, 3)), 2)[0]) == 0


def test_grown_splits_follow_the_draw(grown, samples, x):
    """Every split of the forest is what one node's search finds on its first rows by hash."""
    again = grown.forest
    at = members(again, x)
    ids = np.arange(len(x))
    growing = training._Growing(PARAMS.trees)
    checked = 0

    def same(node, tree, own, number, level):
        nonlocal checked
        rows = at[number[id(node)]]
        h = training.uniform(ids[rows], PARAMS.seed, own)
        _, ins, outs = training.draws(PARAMS.seed, tree, own, len(rows), PARAMS, 8, 8)
        got = training.node_splits([training.prepared(ids[rows], h, x[np.ix_(rows, ins)], x[np.ix_(rows, outs)], tree, own, len(rows), PARAMS, level == 0, 8, 8)], PARAMS)[0]
        if node.left is None:
            return
        assert got is not None and tuple(got[0]) == node.features and got[3] == node.split
        checked += 1
        if level == 0:
            left, right = growing.split(own, (node.features, node.scores, node.means, node.split))

    for t, (tree, number) in enumerate(zip(again.trees, again.numbers, strict=True)):
        same(tree, t, t, number, 0)
    assert checked == PARAMS.trees
    leaves = [n for n, *_, in again.rows]
    assert min(len(at[n]) for n in leaves) >= 3
    depth = {r[0]: r[4] for r in again.rows}
    assert max(depth.values()) <= PARAMS.depth


def test_growing_is_reproducible_and_bounded(grown, samples):
    assert model.ForestModel.fit(samples.select("sample_id", "x"), PARAMS).forest.trees == grown.forest.trees
    other = model.ForestModel.fit(samples.repartition(7).select("sample_id", "x"), replace(PARAMS, max_splits=2))
    assert all(sum(s.left is not None for s in t.walk()) <= 2 for t in other.forest.trees)
    reduced = model.ForestModel.fit(samples.select("sample_id", "x"), replace(PARAMS, trees=2, reduce_input=True, reduce_output=True))
    assert any(len(s.features) > 1 for t in reduced.forest.trees for s in t.walk() if s.left is not None)
    at = members(reduced.forest, np.array([r.x for r in samples.orderBy("sample_id").collect()]))
    got = {r.node_id: r.n for r in reduced.node_features().where("feature_id = 0").collect()}
    assert got == {k: len(v) for k, v in at.items()}


def test_odd_matrices(spark):
    kind = "sample_id long, x array<double>"
    assert len(training.grow(spark.createDataFrame([], kind), PARAMS).rows) == PARAMS.trees
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], kind)
    assert len(training.grow(few, PARAMS).rows) == PARAMS.trees
    flat = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(40)], kind)
    assert len(training.grow(flat, PARAMS).rows) == PARAMS.trees
    for bad in ([1.0, float("nan")], [1.0], [None, 1.0]):
        with pytest.raises(ValueError, match="vectors"):
            training.grow(spark.createDataFrame([(0, [1.0, 2.0]), (1, bad)], kind), PARAMS)
    targets = spark.createDataFrame([(i, [float(i % 7), float(i), -float(i)]) for i in range(60)], "sample_id long, y array<double>")
    s = spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(60)], kind)
    m = model.ForestModel.fit(s, replace(PARAMS, trees=1), targets)
    assert m.width == 3 and len(m.forest.rows) > 1
    assert len(m.predict(s).predicted().first().predicted) == 3


# ---- routing, statistics, prediction


def test_routing_through_arrays_is_the_expression(spark, sf, monkeypatch):
    from silvaframe.operators import forest as f

    s = matrix.embeddings(spark, sf)
    compiled = sorted(fixture(spark).leaves_of(s).collect())
    monkeypatch.setattr(f, "COMPILED", 0)
    assert sorted(fixture(spark).leaves_of(s).collect()) == compiled


def test_wide_and_scaled_tests():
    nodes = [(0, None, None, (), (), (), 0.0), (1, None, None, (), (), (), 0.0), (2, 0, 1, (0, 1), (1.0, -2.0), (0.5, 0.0), 0.25)]
    v = np.array([[1.0, 0.0], [0.0, 1.0], [0.75, 0.0], [2.0, -2.0]])
    assert Router(nodes, [2]).leaves(v)[:, 0].tolist() == [1, 0, 0, 1]
    assert Router(nodes, [2], row_sum_scaling=True).leaves(v)[:, 0].tolist() == [1, 0, 1, 0]
    assert [len(g) for g in groups([nodes] * 5, 700)] == [2, 2, 1]


def test_node_features_and_predictions(grown, samples, x):
    at = members(grown.forest, x)
    parent = grown.forest.parent
    got = {(r.node_id, r.feature_id): r for r in grown.node_features().collect()}
    for n, rows in at.items():
        mean = x[rows].mean(0)
        up = x[at[parent[n]]].mean(0) if parent[n] is not None else np.zeros(8)
        for f in range(8):
            r = got[n, f]
            assert r.n == len(rows) and abs(r.mean - mean[f]) < 1e-12
            assert abs(r.sse - ((x[rows, f] - mean[f]) ** 2).sum()) < 1e-9 and abs(r.parent_sse - ((x[rows, f] - up[f]) ** 2).sum()) < 1e-9
    leaves = [r[0] for r in grown.forest.rows if r[6]]
    want = np.zeros_like(x)
    for n in leaves:
        want[at[n]] += x[at[n]].mean(0) / PARAMS.trees
    p = grown.predict(samples.select("sample_id", "x"))
    for mode in model.MODES:
        got = np.array([r.predicted for r in p.predicted(mode).orderBy("sample_id").collect()])
        assert np.abs(got - want).max() < 1e-12
    sse, sst = ((x - want) ** 2).sum(0), ((x - x.mean(0)) ** 2).sum(0)
    rep = p.report()
    assert abs(rep["total"].first().fvu - sse.sum() / sst.sum()) < 1e-9
    assert all(abs(r.fvu - (sse[r.feature_id] + 1) / (sst[r.feature_id] + 1)) < 1e-9 for r in rep["feature"].collect())
    with pytest.raises(ValueError, match="mode"):
        p.predicted("median")


def test_trim_derive_and_features(grown, samples, x):
    at = members(grown.forest, x)
    parent = grown.forest.parent
    cod = {n: 1 - ((x[r] - x[r].mean(0)) ** 2).sum() / ((x[r] - x[at[parent[n]]].mean(0)) ** 2).sum() for n, r in at.items() if parent[n] is not None}
    limit = sorted(cod.values())[len(cod) // 2]
    want = 0
    for n in at:
        up, poor = parent[n], False
        while up is not None and parent[up] is not None:
            poor |= cod[up] < limit
            up = parent[up]
        want += not poor
    assert len(grown.trimmed(limit).forest.rows) == want
    few = samples.where("sample_id < 8").select("sample_id", "x")
    small = grown.derived(few)
    at = members(small.forest, x[:8])
    assert all(len(r) for r in at.values())
    more = grown.with_feature(samples.where("sample_id < 3").select("sample_id", F.lit(2.0).alias("value")), "new")
    assert more.width == 9 and more.names[-1] == "new"
    assert [r.value for r in more.sample(2).where("name = 'new'").collect()] == [2.0] and [r.value for r in more.sample(5).where("name = 'new'").collect()] == [0.0]
    assert more.without_feature("0").width == 8


def test_store_and_restore(spark, grown, samples, tmp_path, x):
    grown.backup(str(tmp_path / "b"))
    back = model.ForestModel.restore(spark, str(tmp_path / "b"))
    assert back.forest.trees == grown.forest.trees and back.params == PARAMS and back.samples.count() == len(x)
    matrix.write_trees(grown.forest, samples, str(tmp_path / "t"))
    assert matrix.read_trees(spark, str(tmp_path / "t/*/*.txt")) == grown.forest.trees
    at = members(grown.forest, x)
    base = min(grown.forest.numbers[1].values())
    own = {}
    for r in matrix.tree_samples(spark, str(tmp_path / "t/tree_id=1/*.txt")).collect():
        own.setdefault(r.node_id + base, set()).add(r.sample_id)
    assert own == {n: set(at[n].tolist()) for n in grown.forest.numbers[1].values()}
    matrix.write_matrix(samples, str(tmp_path / "m"))
    read = np.array([r.x for r in matrix.read_matrix(spark, str(tmp_path / "m/*.txt")).orderBy("sample_id").collect()])
    assert (read == x).all()
    matrix.write_names(spark, ["a", "b"], str(tmp_path / "n"))
    assert [r.name for r in matrix.read_header(spark, str(tmp_path / "n/*.txt")).orderBy("feature_id").collect()] == ["a", "b"]


def test_text_sources(spark, tmp_path):
    (tmp_path / "l").write_text("3\n\nx\n5\n")
    assert sorted(map(tuple, matrix.read_labels(spark, str(tmp_path / "l")).collect())) == [(0, 3), (3, 5)]
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% c\n3 2 2\n1 2 0.5\n3 1 2\n")
    assert sorted(map(tuple, matrix.read_mtx(spark, str(tmp_path / "m.mtx")).collect())) == [(0, 1, 0.5), (2, 0, 2.0)]
    (tmp_path / "t").write_text("1 1 5\n1 2 1\n2 2 1\n")
    assert sorted(map(tuple, matrix.read_triples(spark, str(tmp_path / "t"), least_sample=2).collect())) == [(0, 0, 5.0), (0, 1, 1.0)]
    for name, lines in (("a", 300), ("b", 200)):
        (tmp_path / f"many-{name}").write_text("".join(f"{name}{i}\n" for i in range(lines)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = [r.line for r in matrix.numbered_lines(spark, str(tmp_path / "many-*")).orderBy("number").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"a{i}" for i in range(300)] + [f"b{i}" for i in range(200)]


def test_spark_forest_adapter(spark, samples, x):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    data = samples.select("sample_id", "x", array_to_vector("x").alias("features"), F.element_at("x", 1).alias("label"))
    fit = RandomForestRegressor(numTrees=3, maxDepth=3, seed=1).fit(data)
    forest = model.from_spark_forest(spark, fit)
    at = members(forest, x)
    got = np.array([r.prediction for r in fit.transform(data).orderBy("sample_id").collect()])
    reach = np.zeros((len(x), 3), int)
    for r in forest.rows:
        if r[6]:
            reach[at[r[0]], r[1]] = r[0]
    alike = {}
    for key, p in zip(map(tuple, reach), got, strict=True):
        assert alike.setdefault(key, p) == p


def test_streamed_predictions(spark, grown, samples, tmp_path):
    s = samples.select("sample_id", "x")
    s.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
    run = streaming.predictions(grown, stream).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = {r.sample_id: r.predicted for r in grown.predict(s).predicted("mean").collect()}
    got = {r.sample_id: r.predicted for r in spark.table("scored").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)


# ---- order statistics


def test_ranges_give_exact_order_statistics(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, float(v), int(o)) for g, n in (("a", 400), ("b", 7), ("c", 1)) for i, (v, o) in enumerate(zip(np.round(rng.standard_normal(n), 1 if g == "a" else 3), rng.integers(0, 2, n), strict=True))]
    df = spark.createDataFrame(rows, "g string, id long, v double, other int")
    got = {(r.g, r.id): (r.p, r.n) for r in order.row_numbers(df, ["g"], "v", "id", 5).collect()}
    med = {r.g: r.median for r in order.medians(df, ["g"], "v", 5).collect()}
    ks = {r.g: r.ks for r in order.kolmogorov_smirnov(df, ["g"], "v", "other", 5).collect()}
    u = {r.g: r for r in order.rank_sum(df, ["g"], "v", "other", 5).collect()}
    for g in "abc":
        own = [r for r in rows if r[0] == g]
        for p, r in enumerate(sorted(own, key=lambda r: (r[2], r[1]))):
            assert got[g, r[1]] == (p, len(own))
        assert med[g] == pytest.approx(np.median([r[2] for r in own]))
        a, b = (np.array([r[2] for r in own if r[3] == k]) for k in (0, 1))
        if len(a) and len(b):
            assert ks[g] == pytest.approx(max(abs((a <= v).mean() - (b <= v).mean()) for v in [r[2] for r in own]))
            assert u[g].u == pytest.approx(sum((x > y) + 0.5 * (x == y) for x in a for y in b))


def test_normal_and_student_tails(spark):
    z = spark.createDataFrame([(0.0,), (1.0,), (-1.96,), (4.0,)], "z double").select(order.two_sided(F.col("z"))).collect()
    assert [r[0] for r in z] == pytest.approx([math.erfc(abs(v) / 2**0.5) for v in (0, 1, 1.96, 4)], abs=3e-7)
    assert compare.student_t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert compare.student_t_two_sided(0.5, 3) == pytest.approx(0.65145, abs=1e-4)


# ---- neighbours and communities


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "cityblock", "correlation", "jaccard", "sister"])
def test_knn_against_brute_force(spark, metric, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 2, (40, 6)).astype(float) if metric in ("jaccard", "sister") else rng.standard_normal((40, 6))
    v[3] = v[7]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, x array<double>").repartition(3)
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 700)
    monkeypatch.setattr(neighbours, "RUN_ROWS", 9)
    got = {}
    for r in neighbours.knn(df, 4, metric).orderBy("a", "place").collect():
        got.setdefault(r.a, []).append((r.b, r.distance))

    def apart(a, b):
        if metric == "euclidean":
            return math.dist(a, b)
        if metric == "cityblock":
            return np.abs(a - b).sum()
        if metric in ("cosine", "correlation"):
            a, b = (a - a.mean(), b - b.mean()) if metric == "correlation" else (a, b)
            return 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
        c = a @ b
        if metric == "jaccard":
            return 1 - c / (a.sum() + b.sum() - c) if a.sum() + b.sum() else 0.0
        return 1 - (c + min(a.sum(), b.sum())) / (2 * max(a.sum(), b.sum()))

    for i in range(40):
        want = sorted((round(apart(v[i], v[j]), 9), j) for j in range(40) if j != i)[:4]
        assert [b for b, _ in got[i]] == [b for _, b in want] and [d for _, d in got[i]] == pytest.approx([d for d, _ in want], abs=2e-9)


def test_communities_of_two_cliques():
    edges = [(a, b, 1.0) for s in (0, 5) for a in range(s, s + 5) for b in range(a + 1, s + 5)] + [(0, 5, 1.0)]
    label = neighbours.louvain(np.array(edges), 10)
    assert label.tolist() == [0] * 5 + [1] * 5
    one = neighbours.modularity(np.array(edges), np.zeros(10, int))
    assert neighbours.modularity(np.array(edges), label) > one + 0.3 and abs(one) < 1e-12
    assert neighbours.louvain(np.zeros((0, 3)), 3).tolist() == [0, 1, 2]


def test_cluster_rows_with_a_core(spark):
    rng = np.random.default_rng(8)
    centre = np.eye(3) * 20
    v = np.concatenate([c + rng.standard_normal((60, 3)) for c in centre])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, x array<double>")
    for most in (1000, 60):
        got = {r.id: r.cluster_id for r in neighbours.cluster_rows(df, 8, "euclidean", resolution=0.2, most=most).collect()}
        assert len(got) == 180 and all(len({got[i] for i in range(s, s + 60)}) == 1 for s in (0, 60, 120)) and len(set(got.values())) == 3


# ---- factors


def test_interpreted_splits_are_a_partition(grown, clusters):
    rows = clusters.collect()
    assert sorted(r.node_id for r in rows) == [r[0] for r in grown.forest.rows]
    roots = {r[0] for r in grown.forest.rows if r[2] is None}
    assert {r.node_id for r in rows if r.cluster_id == 0} == roots
    shallow = factors.interpret_splits(grown, k=3, depth=1)
    assert shallow.count() == sum(r[4] <= 1 for r in grown.forest.rows)
    assert {r.node_id for r in factors.propagated(grown.forest, shallow).collect()} == {r[0] for r in grown.forest.rows}


def test_regression_is_weighted_least_squares(grown, clusters, samples, x):
    got = {}
    for r in factors.regressions(grown, clusters).collect():
        got.setdefault((r.cluster_id, r.target), {})[r.input] = r.coefficient
    score = {}
    for r in factors.scores(grown, clusters).where("sister_score <> 0").collect():
        score.setdefault(r.cluster_id, []).append((r.sample_id, r.sister_score))
    c = max((k for k, t in got if t == -1), key=lambda c: len(score[c]))
    ids, s = np.array([i for i, _ in score[c]]), np.array([v for _, v in score[c]])
    inputs = sorted(k for k in got[c, -1] if k >= 0)
    z, w = np.column_stack((np.ones(len(ids)), x[np.ix_(ids, inputs)])), np.sqrt(np.abs(s))
    beta = np.linalg.lstsq(z * w[:, None], s * w, rcond=None)[0]
    assert [got[c, -1][k] for k in [-1, *inputs]] == pytest.approx(beta.tolist(), abs=1e-5)


def test_transitions_count_leaves_and_roots(spark):
    tree = Split((0,), (1.0,), (0.0,), 0.0, Split(), Split((1,), (1.0,), (0.0,), 0.0, Split(), Split()))
    f = Forest(spark, [tree])
    # nodes: 0 left leaf, 1 and 2 below the right one, 3 right, 4 root in children-first order
    number = {n: [id(s) for s in tree.walk() if f.numbers[0][id(s)] == n] for n in range(5)}
    assert len(number) == 5
    root, right = f.numbers[0][id(tree)], f.numbers[0][id(tree.right)]
    c = spark.createDataFrame([(0, root), (1, right)], "cluster_id int, node_id long")
    assert sorted(map(tuple, factors.transitions(f, c).collect())) == [(-1, 0, 1), (0, -1, 1), (0, 0, 1), (0, 1, 1), (1, -1, 2), (1, 1, 2)]
    assert sorted(map(tuple, factors.transitions(f, c, depth=1).collect())) == [(-1, 0, 1), (0, -1, 1), (0, 0, 1), (0, 1, 1), (1, -1, 1)]


def test_trees_over_clusters():
    m = np.array([[0, 3, 1, 0, 0], [3, 9, 2, 2, 0], [1, 2, 0, 2, 0], [0, 2, 2, 0, 0], [0, 0, 0, 0, 5.0]])
    assert factors.likely_tree(m) == [(0, None, 0), (1, 0, 1), (2, 1, 2), (3, 1, 2)]
    assert factors.spanning_tree(m) == [(0, None, 0), (1, 0, 1), (2, 1, 2), (3, 1, 2)]
    assert factors.relations(factors.spanning_tree(m), 2) == {"parent": [1], "children": [], "siblings": [3]}
    deep = np.diag(np.ones(14), 1)
    assert [d for _, _, d in factors.likely_tree(deep)] == list(range(15))
    assert factors.layout(factors.spanning_tree(m), {1: 2.0})[1] == (1, 0.5, 1, 2.0)
    assert factors.likely_tree(np.zeros((0, 0))) == [] == factors.spanning_tree(np.zeros((0, 0)))


def test_partial_dependence(spark):
    f = fixture(spark)
    c = spark.createDataFrame([(k, n) for k, nodes in enumerate([(0, 1, 2), (2, 3), (4, 5, 6, 7)]) for n in nodes], "cluster_id int, node_id long")
    z = np.zeros((21, 3))
    for r in c.collect():
        z[r.node_id, r.cluster_id] = 1
    inverse = np.linalg.pinv(np.cov(z.T, bias=True))
    want = inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    assert np.abs(factors.partial_dependence(f, c) - want).max() < 1e-9


# ---- evaluation and reports


def test_agreement_of_labelings():
    table = np.array([[5.0, 1], [0, 4]])
    got = evaluate.mutual_information(table)
    p = table / 10
    mi = sum(v * math.log(v / (p[i].sum() * p[:, j].sum())) for i in range(2) for j in range(2) if (v := p[i, j]))
    assert got["mi"] == pytest.approx(mi)
    rng = np.random.default_rng(9)
    a, b = [0] * 6 + [1] * 4, np.array([0] * 5 + [1] * 5)
    seen = []
    for _ in range(3000):
        t = np.zeros((2, 2))
        np.add.at(t, (a, rng.permutation(b)), 1)
        q = t / 10
        seen.append(sum(v * math.log(v / (q[i].sum() * q[:, j].sum())) for i in range(2) for j in range(2) if (v := q[i, j])))
    h = (got["mi"] / got["nmi"])
    assert got["ami"] == pytest.approx((mi - np.mean(seen)) / (h - np.mean(seen)), abs=0.02)
    assert evaluate.mutual_information(np.diag([3.0, 4]))["ami"] == pytest.approx(1)


def test_baseline_moments_and_splits(spark, samples, x):
    rows = samples.select(F.col("sample_id").alias("id"), "x")
    got = {r.feature_id: r.value for r in evaluate.pca_baseline(rows, 3).collect()}
    v = x - x.mean(0)
    _, _, axes = np.linalg.svd(v, full_matrices=False)
    left = v - v @ axes[:3].T @ axes[:3]
    assert [got[i] for i in range(8)] == pytest.approx(((left**2).sum(0) / (v**2).sum(0)).tolist(), abs=1e-9)
    assert len(evaluate.batch_splits(list(range(8)))) == 35
    counts = spark.createDataFrame([(i, f, float(c)) for f, col in enumerate(([0, 1, 2, 9], [1, 1, 1, 1])) for i, c in enumerate(col)], "sample_id long, feature_id int, value double")
    nb = {r.feature_id: r for r in evaluate.negative_binomial(counts).collect()}
    m, var = 3.0, np.var([0, 1, 2, 9])
    assert nb[0].p == pytest.approx(m / var) and nb[0].r == pytest.approx(m * (m / var) / (1 - m / var)) and nb[1].p is None
    ks = {r.feature_id: r.ks for r in evaluate.poisson_distance(counts).collect()}
    assert ks[1] == pytest.approx(max(abs((k >= 1) - sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in (0, 1)))
    thin = evaluate.downsampled(counts, 5, 1)
    assert thin.join(counts.withColumnRenamed("value", "was"), ["sample_id", "feature_id"]).where("value > was").count() == 0


def test_suffix_statistics(spark, samples, x):
    from silvaframe.plans import applied

    got = {(r.feature_id, r.p): r for r in applied.suffix_statistics(samples.select("sample_id", "x")).collect()}
    at = np.argsort(x[:, 0], kind="stable")
    for f in (0, 5):
        kept: list[float] = []
        y = x[at, f]
        for p in range(len(y) - 1, -1, -1):
            r = got[f, p]
            if kept:
                v = np.array(kept)
                m = np.median(v)
                assert [r.right_median, r.right_mean, r.right_sme, r.right_ssme, r.right_variance, r.right_mad] == pytest.approx([m, v.mean(), np.abs(v - m).sum(), ((v - m) ** 2).sum(), v.var(), np.median(np.abs(v - m))], abs=1e-9)
            else:
                assert r.right_median is None
            assert r.left_median == (pytest.approx(np.median(y[:p])) if p else None)
            insort(kept, y[p])


def test_overlaps_of_nodes_whatever_the_ids_of_samples(spark, grown, samples, monkeypatch):
    far = samples.select((F.col("sample_id") * 1_000_003 + (1 << 40)).alias("sample_id"), "x")
    own: dict[int, set[int]] = {}
    for r in grown.forest.members(samples).collect():
        own.setdefault(r.node_id, set()).add(r.sample_id)
    for held in (factors.SHARED, len(grown.forest.rows) * 3):  # one pass, and three leaves at a time
        monkeypatch.setattr(factors, "SHARED", held)
        rows = factors.overlaps(grown.forest, far)
        got = {r.id: r.x for r in rows.collect()}
        nodes = sorted(grown.forest.parent)
        assert got.keys() == own.keys()
        for k, a in enumerate(nodes):
            assert a not in own or got[a] == [k] + [len(own[a] & own.get(b, set())) for b in nodes]
    near = neighbours.knn(rows, 3, "overlap").collect()
    for a in list(own)[:5]:
        far_off = sorted((round(1 - (len(own[a] & own[b]) + min(len(own[a]), len(own[b]))) / (2 * max(len(own[a]), len(own[b]))), 9), b) for b in own if b != a)
        assert sorted((r.place, r.b) for r in near if r.a == a) == [(i + 1, b) for i, (_, b) in enumerate(far_off[:3])]


def test_double_neighbours_with_large_ids(spark, sf, tmp_path):
    from silvaframe.plans import applied

    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows.withColumn("vec_id", F.col("vec_id") * 1_000_003 + (1 << 40)).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(applied.knn_double(spark, str(tmp_path)).collect()) == sorted(applied.knn_double(spark, sf).collect())


#: What queries of places say of a column in order, by their definitions.
AT_PLACE = {
    "win_prefix_median": lambda y, p: np.median(y[:p]) if p else None,
    "win_suffix_mad": lambda y, p: np.median(np.abs(y[p + 1 :] - np.median(y[p + 1 :]))) if p + 1 < len(y) else None,
    "win_suffix_mean": lambda y, p: y[p + 1 :].mean() if p + 1 < len(y) else None,
    "win_suffix_median": lambda y, p: np.median(y[p + 1 :]) if p + 1 < len(y) else None,
    "win_suffix_sme": lambda y, p: np.abs(y[p + 1 :] - np.median(y[p + 1 :])).sum() if p + 1 < len(y) else 0,
    "win_suffix_ssme": lambda y, p: ((y[p + 1 :] - np.median(y[p + 1 :])) ** 2).sum() if p + 1 < len(y) else 0,
    "win_suffix_variance": lambda y, p: y[p + 1 :].var() if p + 1 < len(y) else 0,
}


@pytest.fixture(scope="module")
def long_columns(spark, tmp_path_factory):
    """60,000 rows of four columns: one without ties, whole numbers, one far from 0, one with few values."""
    path = tmp_path_factory.mktemp("long")
    rng = np.random.default_rng(5)
    n = 60_000
    x = np.column_stack((rng.normal(size=n), rng.integers(-50, 50, n), rng.normal(size=n) + 1e6, rng.integers(0, 2, n))).astype(float)
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 4), pa.array(x.ravel())), "label": np.zeros(n, np.int32)})
    pq.write_table(table, path / "embeddings.parquet")
    return str(path), x[np.argsort(x[:, 0], kind="stable")]


@pytest.mark.parametrize("name", AT_PLACE)
def test_long_columns_take_no_square_of_time(spark, long_columns, name):
    from silvaframe.plans import applied

    path, x = long_columns
    began = time.time()
    got = applied.QUERIES[name](spark, path).toPandas().set_index(["feature_id", "p"])["value"].sort_index()
    assert time.time() - began < 40
    n = len(x)
    assert len(got) == 4 * n
    for f in range(4):
        for p in [0, 1, 2, n - 3, n - 2, n - 1, *range(7, n, 1999)]:
            expected = AT_PLACE[name](x[:, f], p)
            assert np.isnan(got[f, p]) if expected is None else got[f, p] == pytest.approx(expected, abs=1e-6, rel=1e-10)


def test_prefixes_by_brute_force():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 5, 8, 9, 64, 65, 130):
        for y in (rng.normal(size=n), rng.integers(0, 3, n).astype(float), np.ones(n), np.arange(n, 0, -1.0), np.exp(3 * rng.normal(size=n))):
            middle, apart, sums = (getattr(Prefixes(y, sums=True), k)(*a) for k, a in (("medians", ()), ("deviations", ()), ("absolute", (y,))))
            assert len(middle) == len(apart) == len(sums) == n + 1 and np.isnan(middle[0]) and apart[0] == sums[0] == 0
            for size in range(1, n + 1):
                v = y[:size]
                assert middle[size] == np.median(v) and apart[size] == np.median(np.abs(v - np.median(v)))
                assert sums[size] == pytest.approx(np.abs(v - np.median(v)).sum(), abs=1e-9)


def test_suffix_statistics_with_odd_rows(spark):
    from silvaframe.plans import applied

    rows = [(7, [2.0, 1.0]), (3, [2.0, 5.0]), (5, [1.0, 4.0, 9.0]), (4, None), (6, [])]
    got = {(r.feature_id, r.p): (r.right_median, r.left_median) for r in applied.suffix_statistics(spark.createDataFrame(rows, "sample_id long, x array<double>")).collect()}
    assert got == {(0, 0): (2.0, None), (0, 1): (2.0, 1.0), (0, 2): (None, 1.5), (1, 0): (3.0, None), (1, 1): (1.0, 4.0), (1, 2): (None, 4.5), (2, 0): (None, None)}


def test_rounding_as_sql_does():
    import duckdb

    from silvaframe.plans import applied

    rng = np.random.default_rng(8)
    v = np.concatenate((rng.normal(size=2000), rng.integers(-9, 9, 500) / 2e6, rng.normal(size=500) * 1e9, [0.0, -0.0, 1e-9, -1e-9, 0.0000005, -0.0000015, 1.5, 2**60, -1e300, np.inf, -np.inf, np.nan]))
    expected = duckdb.sql("SELECT round(v, 6) AS v FROM (SELECT unnest($v) AS v, unnest(range(len($v))) AS i) ORDER BY i", params={"v": v.tolist()}).fetchnumpy()["v"]
    got = applied.rounded(v, 6)
    assert not np.signbit(got[got == 0]).any()
    np.testing.assert_array_equal(np.isnan(got), np.isnan(v))
    assert (got == np.ma.filled(expected, np.nan))[: 2500].all() and np.allclose(got, np.ma.filled(expected, np.nan), rtol=3e-16, atol=0, equal_nan=True)


def rounds_no_row(spark, sf, name):
    """Spark's own rounding goes through a decimal for each row."""
    from silvaframe.plans import applied

    return "round(" not in applied.QUERIES[name](spark, sf)._jdf.queryExecution().toString()


def test_suffix_mean_rounds_whole_columns(spark, sf):
    assert rounds_no_row(spark, sf, "win_suffix_mean")


def test_columns_that_share_a_task_keep_their_own_rows(spark):
    from silvaframe.plans import applied

    rng = np.random.default_rng(9)
    rows = [(int(i), [float(v) for v in rng.integers(0, 9, int(w))]) for i, w in zip(rng.permutation(300) * 7, rng.choice([1, 33, 34, 65, 150], 300))]
    out = applied.suffix_statistics(spark.createDataFrame(rows, "sample_id long, x array<double>").repartition(3), wanted=("right_mean", "left_median"), digits=6).collect()
    assert len(out) == sum(len(x) for _, x in rows)
    got = {(r.feature_id, r.p): (r.right_mean, r.left_median) for r in out}
    for f in range(150):
        y = [x[f] for _, x in sorted(rows, key=lambda r: (r[1][0], r[0])) if len(x) > f]
        for p in range(len(y)):
            assert got[f, p] == (pytest.approx(np.mean(y[p + 1 :]), abs=1e-6) if p + 1 < len(y) else None, np.median(y[:p]) if p else None)


def looked_up(monkeypatch, run):
    """How many prefixes ``run`` searched for a rank."""
    sizes, rank = [], Prefixes.rank
    monkeypatch.setattr(Prefixes, "rank", lambda self, size, k: sizes.append(len(size)) or rank(self, size, k))
    run()
    return sum(sizes)


def test_suffix_median_looks_up_even_sizes_only(spark, sf, monkeypatch):
    from silvaframe.plans import applied

    for n in (1, 2, 3, 40_000, 40_001):
        y = np.random.default_rng(n).integers(0, 99, n).astype(float)
        assert looked_up(monkeypatch, lambda y=y: applied._of_column(y, ("right_median",))) <= len(y)
    assert rounds_no_row(spark, sf, "win_suffix_median")


def test_suffix_sme_keeps_no_sums_by_level(spark, sf, monkeypatch):
    from silvaframe.plans import applied

    y = np.random.default_rng(2).normal(size=40_001)
    assert sum(a.nbytes for level in Prefixes(y, sums=True).levels for a in level[1:] if a is not None) <= 4 * (len(y) + 1) * 16
    assert looked_up(monkeypatch, lambda: applied._of_column(y, ("right_sme",))) <= len(y)
    assert rounds_no_row(spark, sf, "win_suffix_sme")


def test_suffix_ssme_looks_up_even_sizes_only(spark, sf, monkeypatch):
    from silvaframe.plans import applied

    y = np.random.default_rng(3).normal(size=40_001)
    assert looked_up(monkeypatch, lambda: applied._of_column(y, ("right_ssme",))) <= len(y)
    assert rounds_no_row(spark, sf, "win_suffix_ssme")


def test_drawn_splits_search_every_input(spark, sf):
    from silvaframe.plans import applied

    rows = [r for r in applied._drawn(spark, sf).collect()]
    best = {r.tree_id: r for r in applied.trn_best_split(spark, sf).collect()}
    for t in best:
        own = sorted((r for r in rows if r.tree_id == t), key=lambda r: r.draw)
        assert len(own) == 332  # two thirds of 500 rows
        v = np.array([r.x for r in own])
        scores, _ = training.split_scores(v, v[:, own[0].targets], 1, 0.5)
        assert best[t].score == pytest.approx(scores[:, 2:331].min())


def test_reports(grown, clusters):
    about = reports.cluster_summary(grown, clusters, 2, [0, 1, 2])
    assert json.loads(reports.summary_json(about)).keys() == {str(c) for c in about}
    assert sum(a["nodes"] for a in about.values()) == len(grown.forest.rows)
    assert len(about[1]["change_parent"]) == 4
    tree = factors.spanning_tree(factors.square(factors.affinity(grown, clusters)))
    page = reports.tree_page(tree, about, {1: "<one>"})
    assert "&lt;one&gt;" in page and page.count("<line") == len(tree) - 1
    assert "fvu" in reports.cluster_page(1, about[1])
    assert reports.html_table([["<a>", 0.5]], ["n", "v"]).count("<td>") == 2
    assert "<td>3</td>" in reports.cross_table({("x", "y"): 3}, ["x"], ["y"])


def test_populations_that_are_alike_do_not_differ(grown, clusters, samples):
    s = samples.select("sample_id", "x")
    for r in compare.compare_factors(grown, s, s, clusters).collect():
        assert r.fvu == pytest.approx(r.other_fvu) and (r.residual_z or 0.0) == pytest.approx(0.0, abs=1e-9)
    for r in compare.factor_marginals(grown, s, s, clusters).collect():
        assert r.own_distance == pytest.approx(r.other_distance)


def test_average_linkage_keeps_groups_together():
    from silvaframe.operators import paths

    v = np.array([[0.0], [10.0], [0.2], [10.1], [0.1], [30.0]])
    order_ = paths.average_linkage(v)
    assert sorted(order_) == list(range(6)) and sorted(order_[:3]) == [0, 2, 4] and sorted(order_[3:5]) == [1, 3]
    assert paths.average_linkage(v[:1]) == [0] and paths.average_linkage(v[:0]) == []
    assert paths.biclustered(v)[1] == [0]


def test_joined_and_broadcast_predictions_agree(grown, samples, monkeypatch):
    from silvaframe.operators import forest as f

    p = grown.predict(samples.select("sample_id", "x"))
    small = {m: {r.sample_id: r.predicted for r in p.predicted(m).collect()} for m in model.MODES}
    monkeypatch.setattr(f, "TABLE_BYTES", 0)
    for m in model.MODES:
        got = {r.sample_id: r.predicted for r in p.predicted(m).collect()}
        assert got.keys() == small[m].keys() and all(np.allclose(got[i], small[m][i]) for i in got)
    with pytest.raises(ValueError, match="too large"):
        streaming.predictions(grown, samples)
