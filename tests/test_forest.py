import math

import pytest
from pyspark.sql import functions as F

from silvaframe.operators.forest import Forest, Split, fixture
from silvaframe.params import ForestParams, from_flags
from silvaframe.sources import matrix


def test_each_sample_reaches_one_leaf_a_tree(spark, sf):
    s = matrix.embeddings(spark, sf)
    leaves = fixture(spark).leaves_of(s)
    assert leaves.groupBy("sample_id").count().where("count <> 3").count() == 0


def test_children_sum_to_parent(spark, sf):
    f = fixture(spark)
    pop = {r.node_id: r["count"] for r in f.members(matrix.embeddings(spark, sf)).groupBy("node_id").count().collect()}
    for r in f.nodes.where("not is_leaf").collect():
        kids = [n.node_id for n in f.nodes.where(F.col("parent_id") == r.node_id).collect()]
        assert sum(pop[k] for k in kids) == pop[r.node_id]


def test_node_order_puts_children_first_and_root_last(spark):
    rows = fixture(spark).nodes.orderBy("node_id").collect()
    assert [r.level for r in rows[:7]] == [2, 2, 2, 2, 1, 1, 0]
    assert [r.parent_id for r in rows[:7]] == [4, 4, 5, 5, 6, 6, None]


def test_root_only_tree(spark):
    f = Forest(spark, [Split()])
    s = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "sample_id long, x array<double>")
    assert f.members(s).count() == 2


def test_json_round_trip():
    t = Split((0, 2), (0.5, -1.0), (0.1, 0.2), 0.25, Split(), Split((1,), (1.0,), (0.0,), 0.0, Split(), Split()))
    assert matrix.tree_from_json(matrix.tree_to_json(t)) == t


def test_readers(spark, tmp_path):
    (tmp_path / "m").write_text("1 2\t3\n4 5 6\n")
    assert [r.x for r in matrix.read_matrix(spark, str(tmp_path / "m")).orderBy("sample_id").collect()] == [[1, 2, 3], [4, 5, 6]]
    (tmp_path / "b").write_text("1 x\n")
    with pytest.raises(Exception, match="not a finite number"):
        matrix.read_matrix(spark, str(tmp_path / "b")).collect()
    assert matrix.read_matrix(spark, str(tmp_path / "b"), 0.0).first().x == [1, 0]
    (tmp_path / "h").write_text('"a"\na\nb\n')
    assert [r.name for r in matrix.read_header(spark, str(tmp_path / "h")).orderBy("feature_id").collect()] == ["a", "a1", "b"]
    (tmp_path / "t").write_text("1 2 0.5\n3 1 2\n")
    assert {tuple(r) for r in matrix.read_triples(spark, str(tmp_path / "t")).collect()} == {(0, 1, 0.5), (2, 0, 2.0)}


def test_parameters():
    p = from_flags(["-t", "5", "-norm", "L1", "-sfr", "0", "-ri", "true"])
    assert (p.trees, p.norm, p.balance, p.reduce_input) == (5, 1, 0.0, True)
    assert ForestParams().auto(150, 4).samples == 100
    assert ForestParams().auto(10_000, 100).depth == int(math.log(10_000, 5))
    with pytest.raises(ValueError, match="norm"):
        ForestParams(norm=3)


def test_golden_remaining_error(spark, sf):
    from silvaframe.plans import catalogue

    got = {r.feature_id: r.value for r in catalogue.QUERIES["met_remaining_error"](spark, sf).collect()}
    want = (0.637069383, 0.625261025, 0.645244391, 0.990755934, 0.820143498, 0.81292351)
    assert all(abs(got[i] - w) < 1e-6 for i, w in enumerate(want))


def test_additive_prediction_is_mean_prediction(spark, sf):
    from silvaframe.plans import catalogue

    a, m = (catalogue.QUERIES[n](spark, sf).withColumnRenamed("predicted", n) for n in ("prd_additive", "prd_mean"))
    assert a.join(m, ["sample_id", "feature_id"]).where("abs(prd_additive - prd_mean) > 2e-6").count() == 0


def test_ties_and_near_ties_go_to_the_larger_share(spark):
    """A share that is larger by less than a thousandth of the label's number still wins."""
    import re

    from silvaframe.plans import catalogue

    body = re.search(r"SELECT sample_id, label AS cluster_id FROM \(SELECT sample_id, label, row_number.*", catalogue.PLANS["prd_sample_cluster"])[0]
    inner = body.index("(SELECT m.sample_id")
    rows = "(SELECT * FROM VALUES (1, 0, 0.5D), (1, 9, 0.5001D), (2, 3, 0.5D), (2, 1, 0.5D) v(sample_id, label, share))"
    got = spark.sql(body[:inner] + rows + " z) y WHERE place = 1").collect()
    assert sorted(map(tuple, got)) == [(1, 9), (2, 1)]


def test_node_samples_in_tree_json():
    t = Split((0,), (1.0,), (0.0,), 0.0, Split(), Split())
    import json

    got = json.loads(matrix.tree_to_json(t, {0: [1], 1: [2], 2: [1, 2]}))
    assert (got["samples"], [c["samples"] for c in got["children"]]) == ([1, 2], [[1], [2]])
