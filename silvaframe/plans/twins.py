"""DuckDB twins, written by hand, of the queries in ``applied`` that no plan of the catalogue states already."""

from __future__ import annotations

_ROOTED = "(SELECT p.node_id, p.ancestor_id AS other_id FROM {path} p JOIN {node} n ON n.node_id = p.ancestor_id WHERE n.parent_id IS NULL)"
_SISTER = "(SELECT node_id, sister_id AS other_id FROM {node} WHERE sister_id IS NOT NULL)"


def _change(pairs: str, log: bool) -> str:
    value = "log2(o.m / t.m)" if log else "o.m - t.m"
    fine = " WHERE o.m > 0 AND t.m > 0" if log else ""
    return f"""WITH pairs AS (SELECT k.cluster_id, e.node_id, e.other_id FROM {{cluster}} k JOIN {pairs} e ON e.node_id = k.node_id),
        o AS (SELECT cluster_id, feature_id, avg(mean) AS m FROM pairs JOIN {{nf}} f ON f.node_id = pairs.node_id GROUP BY ALL),
        t AS (SELECT cluster_id, feature_id, avg(mean) AS m FROM pairs JOIN {{nf}} f ON f.node_id = pairs.other_id GROUP BY ALL)
        SELECT o.cluster_id, o.feature_id, {{r: {value} :r}} AS value FROM o JOIN t USING (cluster_id, feature_id){fine}"""


#: Rows of each column in the order of the first column.
_ORDERED = "SELECT t.feature_id, t.sample_id, t.value AS y, row_number() OVER (PARTITION BY t.feature_id ORDER BY i.value, i.sample_id) - 1 AS p FROM {cell} t JOIN {cell} i ON i.sample_id = t.sample_id AND i.feature_id = 0"
_RIGHT = "SELECT feature_id, p, y, median(y) OVER (PARTITION BY feature_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS m FROM (" + _ORDERED + ") o"


def _beyond(value: str) -> str:
    return f"WITH s AS MATERIALIZED ({_RIGHT}) SELECT a.feature_id, a.p, {{r: {value} :r}} AS value FROM s a LEFT JOIN s b ON b.feature_id = a.feature_id AND b.p > a.p GROUP BY a.feature_id, a.p"


#: Squared errors of one half of the samples about the training means of a node and its parent.
_HALF = """SELECT m.node_id, c.feature_id, c.sample_id % 2 AS side, count(*) AS n, sum(power(c.value - f.mean, 2)) AS sse, sum(power(c.value - coalesce(u.mean, 0), 2)) AS up
    FROM {member} m JOIN {cell} c ON c.sample_id = m.sample_id JOIN {node} k ON k.node_id = m.node_id JOIN {nf} f ON f.node_id = m.node_id AND f.feature_id = c.feature_id
    LEFT JOIN {nf} u ON u.node_id = k.parent_id AND u.feature_id = c.feature_id GROUP BY ALL"""

_COUNTS = "SELECT sample_id, feature_id, floor(abs(value) * 20) AS value FROM {cell}"

TWINS: dict[str, str] = {
    "agg_feature_median": "SELECT feature_id, {r: median(value) :r} AS value FROM {cell} GROUP BY feature_id",
    "knn_samples": """SELECT a, b, place FROM (SELECT a.sample_id AS a, b.sample_id AS b, row_number() OVER (PARTITION BY a.sample_id ORDER BY round(1 - list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))), 9), b.sample_id) AS place
        FROM {sample} a JOIN {sample} b ON b.sample_id <> a.sample_id) q WHERE place <= 10""",
    "trv_child_clusters": "SELECT n.node_id, d.lr, k.cluster_id, count(*) AS times FROM {node} n JOIN {node} d ON d.parent_id = n.node_id JOIN {path} p ON p.ancestor_id = d.node_id JOIN {cluster} k ON k.node_id = p.node_id GROUP BY ALL",
    "con_affinity_means": """WITH m AS (SELECT cluster_id, feature_id, avg(mean) AS v FROM {cluster} JOIN {nf} USING (node_id) GROUP BY ALL)
        SELECT a.cluster_id AS parent, b.cluster_id AS child, {r: sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) :r} AS value FROM m a JOIN m b ON a.feature_id = b.feature_id AND a.cluster_id <> b.cluster_id GROUP BY ALL""",
    "fac_change_root": _change(_ROOTED, False),
    "fac_change_log2_root": _change(_ROOTED, True),
    "fac_change_log2_sister": _change(_SISTER, True),
    "fac_strict_fraction": "SELECT k.cluster_id, {r: sum(d.own) / sum(d.parent) :r} AS fvu FROM {cluster} k JOIN {node} n ON n.node_id = k.node_id AND n.parent_id IS NOT NULL JOIN {doublet} d ON d.node_id = k.node_id GROUP BY k.cluster_id",
    "fac_parent_scores": "SELECT k.cluster_id, m.sample_id, {r: count(*) / (max(z.n) + 1.0) :r} AS score FROM {cluster} k JOIN {node} n ON n.node_id = k.node_id JOIN {member} m ON m.node_id = coalesce(n.parent_id, n.node_id) JOIN (SELECT cluster_id, count(*) AS n FROM {cluster} GROUP BY cluster_id) z ON z.cluster_id = k.cluster_id GROUP BY k.cluster_id, m.sample_id",
    "fac_enrichment": """WITH below AS (SELECT p.ancestor_id, s.cluster_id AS downstream FROM {path} p JOIN {split_label} s ON s.node_id = p.node_id WHERE p.distance > 0),
        base AS (SELECT downstream, count(*) / sum(count(*)) OVER () AS share FROM below JOIN {node} n ON n.node_id = below.ancestor_id WHERE n.parent_id IS NULL GROUP BY downstream),
        own AS (SELECT k.cluster_id, downstream, count(*) / sum(count(*)) OVER (PARTITION BY k.cluster_id) AS share FROM {cluster} k JOIN below ON below.ancestor_id = k.node_id GROUP BY k.cluster_id, downstream)
        SELECT own.cluster_id, own.downstream, {r: own.share / base.share :r} AS value FROM own JOIN base USING (downstream)""",
    "fac_most_local": """WITH w AS (SELECT cluster_id, sample_id, own AS w FROM {score} WHERE own > 0),
        pairs AS (SELECT a.sample_id, a.feature_id AS feature_a, b.feature_id AS feature_b, a.value AS x, b.value AS y FROM {cell} a JOIN {cell} b ON a.sample_id = b.sample_id AND a.feature_id < b.feature_id WHERE b.feature_id < 10),
        whole AS (SELECT feature_a, feature_b, corr(x, y) AS c FROM pairs GROUP BY ALL),
        sums AS (SELECT cluster_id, feature_a, feature_b, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * y) / sum(w) AS xy, sum(w * x * x) / sum(w) AS xx, sum(w * y * y) / sum(w) AS yy FROM w JOIN pairs USING (sample_id) GROUP BY ALL),
        deltas AS (SELECT cluster_id, feature_a, feature_b, (xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)) - c AS delta FROM sums JOIN whole USING (feature_a, feature_b))
        SELECT cluster_id, feature_a, feature_b, {r: delta :r} AS delta FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(abs(delta), 9) DESC, feature_a, feature_b) AS place FROM deltas) q WHERE place <= 5""",
    "cmp_factor_fvu": "WITH half AS MATERIALIZED (" + _HALF + """),
        nodes AS (SELECT k.cluster_id, h.node_id, h.side, sum(sse) AS sse, sum(up) AS up FROM {cluster} k JOIN half h ON h.node_id = k.node_id GROUP BY ALL),
        fvu AS (SELECT cluster_id, sum(sse) FILTER (WHERE side = 0) / sum(up) FILTER (WHERE side = 0) AS fvu, sum(sse) FILTER (WHERE side = 1) / sum(up) FILTER (WHERE side = 1) AS other_fvu FROM nodes GROUP BY cluster_id),
        u AS (SELECT a.cluster_id, sum(CASE WHEN round(1 - a.sse / a.up, 9) > round(1 - b.sse / b.up, 9) THEN 1.0 WHEN round(1 - a.sse / a.up, 9) = round(1 - b.sse / b.up, 9) THEN 0.5 ELSE 0.0 END) AS u FROM nodes a JOIN nodes b ON a.cluster_id = b.cluster_id AND a.side = 0 AND b.side = 1 GROUP BY a.cluster_id)
        SELECT cluster_id, {r: fvu :r} AS fvu, {r: other_fvu :r} AS other_fvu, {r: u :r} AS u FROM fvu JOIN u USING (cluster_id)""",
    "cmp_factor_residuals": "WITH half AS MATERIALIZED (" + _HALF + """),
        nodes AS (SELECT k.cluster_id, h.node_id, h.side, sum(sse) / sum(n) AS mse FROM {cluster} k JOIN half h ON h.node_id = k.node_id GROUP BY ALL),
        sides AS (SELECT cluster_id, avg(mse) FILTER (WHERE side = 0) AS a, avg(mse) FILTER (WHERE side = 1) AS b, var_pop(mse) FILTER (WHERE side = 0) / (count(*) FILTER (WHERE side = 0) - 1) AS va, var_pop(mse) FILTER (WHERE side = 1) / (count(*) FILTER (WHERE side = 1) - 1) AS vb FROM nodes GROUP BY cluster_id)
        SELECT cluster_id, {r: b - a :r} AS delta, CASE WHEN va + vb > 1e-18 THEN round((b - a) / sqrt(va + vb), 3) END AS z FROM sides""",
    "cmp_factor_means_rank": """WITH centre AS (SELECT cluster_id, feature_id, avg(mean) AS c FROM {cluster} JOIN {nf} USING (node_id) GROUP BY ALL),
        own AS (SELECT k.cluster_id, f.node_id, sqrt(sum(power(f.mean - e.c, 2))) AS d FROM {cluster} k JOIN {nf} f ON f.node_id = k.node_id JOIN centre e ON e.cluster_id = k.cluster_id AND e.feature_id = f.feature_id GROUP BY ALL),
        new AS (SELECT m.node_id, c.feature_id, avg(c.value) AS mean FROM {member} m JOIN {cell} c ON c.sample_id = m.sample_id WHERE c.sample_id % 2 = 1 GROUP BY ALL),
        far AS (SELECT cluster_id, avg(d) AS d FROM (SELECT k.cluster_id, f.node_id, sqrt(sum(power(f.mean - e.c, 2))) AS d FROM {cluster} k JOIN new f ON f.node_id = k.node_id JOIN centre e ON e.cluster_id = k.cluster_id AND e.feature_id = f.feature_id GROUP BY ALL) q GROUP BY cluster_id)
        SELECT own.cluster_id, {r: far.d :r} AS other_distance, count(*) FILTER (WHERE own.d < far.d) AS rank, count(*) AS nodes FROM own JOIN far ON far.cluster_id = own.cluster_id GROUP BY own.cluster_id, far.d""",
    "cmp_factor_marginals": """WITH means AS (SELECT m.node_id, c.feature_id, c.sample_id % 2 AS side, avg(c.value) AS mean FROM {member} m JOIN {cell} c ON c.sample_id = m.sample_id GROUP BY ALL),
        marginal AS (SELECT k.cluster_id, a.node_id, a.feature_id, a.side, a.mean - p.mean AS v FROM {cluster} k JOIN means a ON a.node_id = k.node_id JOIN {node} n ON n.node_id = a.node_id JOIN means p ON p.node_id = n.parent_id AND p.feature_id = a.feature_id AND p.side = a.side),
        centre AS (SELECT cluster_id, feature_id, avg(v) AS c FROM marginal WHERE side = 0 GROUP BY ALL),
        apart AS (SELECT m.cluster_id, m.node_id, m.side, 1 - sum(v * c) / sqrt(sum(v * v) * sum(c * c)) AS d FROM marginal m JOIN centre e ON e.cluster_id = m.cluster_id AND e.feature_id = m.feature_id GROUP BY ALL)
        SELECT cluster_id, {r: avg(d) FILTER (WHERE side = 0) :r} AS own_distance, {r: avg(d) FILTER (WHERE side = 1) :r} AS other_distance FROM apart GROUP BY cluster_id""",
    "enc_weight": "SELECT n.node_id, f.range::INTEGER AS feature_id, 1.0 AS value FROM {node} n, range(64) f",
    "enc_gain": "SELECT d.node_id, d.feature_id, {r: coalesce(p.own - d.own, 0) :r} AS value FROM {doublet} d JOIN {node} n ON n.node_id = d.node_id LEFT JOIN {doublet} p ON p.node_id = n.parent_id AND p.feature_id = d.feature_id",
    "enc_error_ratio": "SELECT d.node_id, d.feature_id, {r: (d.own + 1) / (CASE WHEN n.parent_id IS NULL THEN d.own ELSE d.parent END + 1) :r} AS value FROM {doublet} d JOIN {node} n ON n.node_id = d.node_id",
    "enc_partial": """SELECT g.node_id, g.feature_id, {r: CASE WHEN n.is_leaf = 1 THEN g.gain ELSE g.gain * b.between_ / d.own END :r} AS value FROM {gain} g JOIN {node} n ON n.node_id = g.node_id JOIN {doublet} d ON d.node_id = g.node_id AND d.feature_id = g.feature_id
        LEFT JOIN (SELECT c.parent_id AS node_id, k.feature_id, sum(k.population * power(f.mean - k.mean, 2)) AS between_ FROM {node} c JOIN {nf} k ON k.node_id = c.node_id JOIN {nf} f ON f.node_id = c.parent_id AND f.feature_id = k.feature_id GROUP BY ALL) b ON b.node_id = g.node_id AND b.feature_id = g.feature_id""",
    "enc_additive": "SELECT a.node_id, a.feature_id, {r: a.median - coalesce(p.median, 0) :r} AS value FROM {node} n JOIN {nmed} a ON a.node_id = n.node_id LEFT JOIN {nmed} p ON p.node_id = n.parent_id AND p.feature_id = a.feature_id",
    "nb_negative_binomial": "SELECT feature_id, {r: p :r} AS p, {r: m * p / (1 - p) :r} AS r FROM (SELECT feature_id, avg(value) AS m, CASE WHEN var_pop(value) > avg(value) THEN avg(value) / var_pop(value) END AS p FROM (" + _COUNTS + ") c GROUP BY feature_id) q",
    "nb_poisson_ks": """WITH RECURSIVE counts AS (SELECT feature_id, value::INTEGER AS k, count(*) AS n FROM (""" + _COUNTS + """) c GROUP BY ALL), whole AS (SELECT feature_id, sum(n) AS total, sum(n * k) / sum(n) AS m, max(k) AS top FROM counts GROUP BY feature_id),
        law AS (SELECT feature_id, 0 AS k, exp(-m) AS term, exp(-m) AS upto, m, top, total FROM whole UNION ALL SELECT feature_id, k + 1, term * m / (k + 1), upto + term * m / (k + 1), m, top, total FROM law WHERE k < top)
        SELECT l.feature_id, {r: max(abs((SELECT sum(n) FROM counts c WHERE c.feature_id = l.feature_id AND c.k <= l.k) / l.total - l.upto)) :r} AS ks FROM law l GROUP BY l.feature_id""",
    "pre_filtered": "WITH c AS (" + _COUNTS + """), s AS (SELECT sample_id FROM c GROUP BY sample_id HAVING count(*) FILTER (WHERE value <> 0) >= 55 AND sum(value) >= 90), l AS (SELECT * FROM c WHERE sample_id IN (SELECT sample_id FROM s)),
        f AS (SELECT feature_id FROM l GROUP BY feature_id HAVING count(*) FILTER (WHERE value <> 0) >= 400) SELECT sample_id, feature_id, value FROM l WHERE feature_id IN (SELECT feature_id FROM f)""",
    "nb_jaccard_runs": """WITH l AS (SELECT sample_id, label AS i, CASE WHEN x[1] > 0 THEN 1 ELSE 0 END AS j FROM {sample}), pairs AS (SELECT i, j, count(*) AS n FROM l GROUP BY i, j), scored AS (SELECT i, j, n / ((SELECT count(*) FROM l a WHERE a.i = p.i) + (SELECT count(*) FROM l b WHERE b.j = p.j) - n) AS jaccard FROM pairs p)
        SELECT i, j, {r: jaccard :r} AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY jaccard DESC, j) AS place FROM scored) q WHERE place = 1""",
    "trv_path_vectors": "SELECT node_id, string_agg(ancestor_id::VARCHAR, '/' ORDER BY distance DESC) AS path FROM {path} GROUP BY node_id",
    "trv_consensus_levels": "SELECT k.cluster_id, n.level, p.ancestor_id, {r: count(*) / max(z.n) :r} AS share FROM {cluster} k JOIN {path} p ON p.node_id = k.node_id JOIN {node} n ON n.node_id = p.ancestor_id JOIN (SELECT cluster_id, count(*) AS n FROM {cluster} GROUP BY cluster_id) z ON z.cluster_id = k.cluster_id GROUP BY k.cluster_id, n.level, p.ancestor_id",
    "trv_sorted_nodes": "SELECT m.node_id, m.sample_id, row_number() OVER (PARTITION BY m.node_id ORDER BY c.value, c.sample_id) - 1 AS place FROM {member} m JOIN (SELECT DISTINCT parent_id AS node_id, feature FROM {node} WHERE parent_id IS NOT NULL) t ON t.node_id = m.node_id JOIN {cell} c ON c.sample_id = m.sample_id AND c.feature_id = t.feature",
    "enc_path": "SELECT c.cluster_id, n.node_id, CASE WHEN k.node_id IS NULL THEN 0 ELSE 1 END AS value FROM (SELECT DISTINCT cluster_id FROM {cluster}) c CROSS JOIN {node} n LEFT JOIN {cluster} k ON k.cluster_id = c.cluster_id AND k.node_id = n.node_id",
    "src_matrix_text": "SELECT sample_id, feature_id, {r: value :r} AS value FROM {cell}",
    "src_triples": "SELECT c.sample_id, feature_id, {r: value :r} AS value FROM {cell} c JOIN (SELECT sample_id FROM {cell} WHERE value > 0 GROUP BY sample_id HAVING sum(value) >= 2.5) s ON s.sample_id = c.sample_id WHERE value > 0",
    "src_mtx": "SELECT sample_id, feature_id, {r: value :r} AS value FROM {cell} WHERE value > 0",
    "src_header_file": "SELECT range::INTEGER AS feature_id, CASE WHEN range < 7 THEN 'g' || range % 7 ELSE 'g' || range % 7 || range // 7 END AS name FROM range(64)",
    "src_node_labels": "SELECT node_id, cluster_id FROM {cluster}",
    "snk_tree_json": "SELECT node_id, tree_id, parent_id, level, lr, feature FROM {node}",
    "snk_tree_samples": "SELECT node_id, sample_id FROM {member}",
    "snk_backup": "SELECT m.sample_id, f.feature_id, {r: avg(f.mean) :r} AS predicted FROM {member} m JOIN {node} n ON n.node_id = m.node_id AND n.is_leaf = 1 JOIN {nf} f ON f.node_id = m.node_id GROUP BY m.sample_id, f.feature_id",
    "win_suffix_median": f"SELECT feature_id, p, {{r: m :r}} AS value FROM ({_RIGHT}) q",
    "win_prefix_median": "SELECT feature_id, p, {r: median(y) OVER (PARTITION BY feature_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) :r} AS value FROM (" + _ORDERED + ") o",
    "win_suffix_mean": "SELECT feature_id, p, {r: avg(y) OVER (PARTITION BY feature_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) :r} AS value FROM (" + _ORDERED + ") o",
    "win_suffix_sme": _beyond("coalesce(sum(abs(b.y - a.m)), 0)"),
    "win_suffix_ssme": _beyond("coalesce(sum(power(b.y - a.m, 2)), 0)"),
    "win_suffix_variance": _beyond("coalesce(var_pop(b.y), 0)"),
    "win_suffix_mad": _beyond("median(abs(b.y - a.m))"),
}
