import duckdb
import pytest

from silvaframe.plans import catalogue

NAMES = ["agg_node_median", "agg_partials", "trv_closure_recursive", "trv_trim", "prd_factor_matrix", "met_factor_mse_iqr", "cmp_ks", "cmp_symmetric_kl", "fac_odds_ratio", "con_likely_tree", "trn_bag", "trn_draw", "prd_sample_cluster", "prd_observed_marginal", "con_transitions", "cmp_rank_sum", "cmp_factor_fvu", "fac_enrichment", "knn_double", "win_suffix_mad", "nb_calinski"]


def test_every_plan_has_a_twin():
    assert set(catalogue.PLANS) <= set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
    assert len(catalogue.ORACLE_SQL) >= 170


@pytest.mark.parametrize("name", NAMES)
def test_plan_equals_twin(spark, sf, name):
    from parity import normal

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    assert normal(catalogue.QUERIES[name](spark, sf).toPandas()) == normal(con.sql(catalogue.ORACLE_SQL[name]).df())
