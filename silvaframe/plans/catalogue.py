"""Named plans over the fixture forest on the embeddings table, each with its SQL twin."""

from __future__ import annotations

from functools import partial

from . import applied
from .relations import duck, fixture_relations
from .twins import TWINS

CHANGE = "(SELECT cl.cluster_id, f.feature_id, avg(f.mean) AS a FROM {cluster} cl JOIN {nf} f ON f.node_id = cl.node_id GROUP BY cl.cluster_id, f.feature_id)"
SIGN = "(SELECT sample_id, feature_id, value, CASE WHEN sample_id % 2 = 1 THEN 1 ELSE 0 END AS other FROM {cell})"
RANKED = f"(SELECT feature_id, other, rank() OVER (PARTITION BY feature_id ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2.0 AS r FROM {SIGN} q)"
WCORR = """SELECT cluster_id, a.feature_id AS feature_a, b.feature_id AS feature_b, sum(w) AS w, sum(w * a.value) AS wx, sum(w * b.value) AS wy, sum(w * a.value * b.value) AS wxy, sum(w * a.value * a.value) AS wxx, sum(w * b.value * b.value) AS wyy
    FROM (SELECT cluster_id, sample_id, own AS w FROM {score} WHERE own > 0) s JOIN {cell} a ON a.sample_id = s.sample_id JOIN {cell} b ON b.sample_id = s.sample_id GROUP BY cluster_id, a.feature_id, b.feature_id"""
CORR = "(wxy - wx * wy / w) / sqrt(nullif((wxx - wx * wx / w) * (wyy - wy * wy / w), 0))"
GLOBAL = "SELECT a.feature_id AS feature_a, b.feature_id AS feature_b, corr(a.value, b.value) AS c FROM {cell} a JOIN {cell} b ON b.sample_id = a.sample_id GROUP BY a.feature_id, b.feature_id"
PAIR = "SELECT a.node_id AS node_a, b.node_id AS node_b, count(*) AS c FROM {member} a JOIN {member} b ON b.sample_id = a.sample_id GROUP BY a.node_id, b.node_id"
NODE_PAIR = "SELECT a.node_id AS node_a, b.node_id AS node_b, coalesce(p.c, 0) AS c, x.population AS na, y.population AS nb FROM {node} a CROSS JOIN {node} b JOIN {pop} x ON x.node_id = a.node_id JOIN {pop} y ON y.node_id = b.node_id LEFT JOIN (" + PAIR + ") p ON p.node_a = a.node_id AND p.node_b = b.node_id"
DIST = "SELECT a.node_id AS a, b.node_id AS b, sqrt(sum(power(a.mean - b.mean, 2))) AS euclid, 1 - sum(a.mean * b.mean) / nullif(sqrt(sum(a.mean * a.mean)) * sqrt(sum(b.mean * b.mean)), 0) AS cosine, sum(abs(a.mean - b.mean)) AS city, 1 - corr(a.mean, b.mean) AS correlation FROM {nf} a JOIN {nf} b ON b.feature_id = a.feature_id WHERE a.node_id <> b.node_id GROUP BY a.node_id, b.node_id"
CHANGED = "SELECT k.cluster_id, o.feature_id, avg(o.mean) AS own, avg(p.mean) AS other FROM {cluster} k JOIN {node} n ON n.node_id = k.node_id JOIN {nf} o ON o.node_id = n.node_id JOIN {nf} p ON p.node_id = n.{WHO} AND p.feature_id = o.feature_id GROUP BY k.cluster_id, o.feature_id"
PARENTS = CHANGED.replace("{WHO}", "parent_id")
SISTERS = CHANGED.replace("{WHO}", "sister_id")
AFFINITY = """SELECT p.cluster_id AS parent, c.cluster_id AS child, sum(p.z * c.z) AS affinity FROM (SELECT cluster_id, sample_id, own / n / nullif(sum(own / n) OVER (PARTITION BY sample_id), 0) AS z FROM {score}) p
    JOIN (SELECT cluster_id, sample_id, own / n / nullif(sum(own / n) OVER (PARTITION BY sample_id), 0) AS z FROM {score}) c ON c.sample_id = p.sample_id WHERE p.cluster_id <> c.cluster_id GROUP BY p.cluster_id, c.cluster_id"""
TRANSITION = "SELECT parent, child, count(*) AS k FROM (SELECT coalesce(a.cluster_id, -1) AS parent, b.cluster_id AS child FROM {node} n LEFT JOIN {split_label} a ON a.node_id = n.parent_id JOIN {split_label} b ON b.node_id = n.node_id UNION ALL SELECT c.cluster_id, -1 FROM {node} l JOIN {split_label} c ON c.node_id = l.node_id WHERE l.is_leaf = 1) steps GROUP BY parent, child"
LIKELY = "SELECT child, parent FROM (SELECT child, parent, row_number() OVER (PARTITION BY child ORDER BY k DESC, parent) AS place FROM (" + TRANSITION + ") q WHERE parent >= 0 AND parent <> child AND child > 0) z WHERE place = 1"
NORM = "SELECT sample_id, feature_id, ln(1 + abs(value) * m.target / t.total) AS v FROM {cell} JOIN (SELECT sample_id AS id, sum(abs(value)) AS total FROM {cell} GROUP BY sample_id) t ON t.id = sample_id CROSS JOIN (SELECT median(total) AS target FROM (SELECT sum(abs(value)) AS total FROM {cell} GROUP BY sample_id) q) m"
OTHER = "(SELECT m.node_id, c.feature_id, avg(c.value) AS mean FROM {member} m JOIN {cell} c ON c.sample_id = m.sample_id WHERE c.sample_id % 2 = 1 GROUP BY m.node_id, c.feature_id)"
CH = "SELECT feature_id, label, avg(value) AS mean, count(*) AS n FROM {cell} JOIN (SELECT sample_id AS id, label FROM {sample}) l ON l.id = sample_id GROUP BY feature_id, label"

#: Plan name -> body; {name} is a relation, {r: x :r} rounds to six places.
PLANS: dict[str, str] = {
    "prj_matrix_long": "SELECT sample_id, feature_id, {r: value :r} AS value FROM {cell}",
    "prj_linear_score": "SELECT sample_id, {r: ({dim 0} - 0.1) * 0.5 + ({dim 1} + 0.2) * -1.5 + {dim 2} * 2 + ({dim 3} - 0.05) * 0.25 :r} AS score FROM {sample}",
    "prj_scaled_score": "SELECT sample_id, {r: (({dim 0} - 0.1) * 0.5 + ({dim 1} + 0.2) * -1.5) / nullif({dim 0} + {dim 1}, 0) :r} AS score FROM {sample}",
    "prj_double_select": "SELECT d.tree_id, d.draw, c.feature_id, {r: c.value :r} AS value FROM {draw} d JOIN {cell} c ON c.sample_id = d.sample_id WHERE c.feature_id IN (1, 3, 5)",
    "prj_logistic": "SELECT sample_id, feature_id, {r: 1 / (1 + exp(-value)) :r} AS value FROM {cell}",
    "prj_append_feature": "SELECT sample_id, feature_id, {r: value :r} AS value FROM {cell} UNION ALL SELECT sample_id, 64, {r: sum(value) :r} FROM {cell} GROUP BY sample_id",
    "flt_drop_features": "SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY feature_id) - 1 AS BIGINT) AS feature_id, {r: value :r} AS value FROM {cell} WHERE feature_id NOT IN (1, 5, 7)",
    "flt_node_filter": "SELECT sample_id, CASE WHEN {dim 0} > 0 THEN 1 ELSE 0 END AS goes_right FROM {sample}",
    "flt_scaled_filter": "SELECT sample_id, CASE WHEN ({dim 0} - 0.1) / nullif({dim 0}, 0) > 0.5 THEN 1 ELSE 0 END AS goes_right FROM {sample}",
    "flt_blank_filter": "SELECT sample_id, 1 AS passes FROM {sample}",
    "flt_leaf_members": "SELECT m.node_id, m.sample_id FROM {member} m WHERE m.node_id IN (SELECT node_id FROM {node} WHERE is_leaf = 1)",
    "flt_depth_nodes": "SELECT node_id, level FROM {node} WHERE level <= 1",
    "trv_nodes": "SELECT node_id, tree_id, parent_id, sister_id, level, lr FROM {node}",
    "trv_leaves": "SELECT node_id FROM {node} WHERE is_leaf = 1",
    "trv_leaves_at_depth": "SELECT node_id FROM {node} WHERE level = 1 OR (is_leaf = 1 AND level < 1)",
    "trv_stems": "SELECT node_id FROM {node} WHERE is_leaf = 0 AND parent_id IS NOT NULL",
    "trv_roots": "SELECT p.node_id, p.ancestor_id AS root_id FROM {path} p JOIN {node} n ON n.node_id = p.ancestor_id WHERE n.parent_id IS NULL",
    "trv_levels": "SELECT tree_id, level, count(*) AS nodes FROM {node} GROUP BY tree_id, level",
    "trv_depth": "SELECT ancestor_id AS node_id, CAST(max(distance) AS INTEGER) AS depth FROM {path} GROUP BY ancestor_id",
    "trv_sisters": "SELECT a.node_id, b.node_id AS sister_id FROM {node} a JOIN {node} b ON a.parent_id = b.parent_id AND a.node_id <> b.node_id",
    "trv_closure": "SELECT node_id, ancestor_id, CAST(distance AS INTEGER) AS distance FROM {path}",
    "trv_closure_recursive": "WITH RECURSIVE up(node_id, ancestor_id) AS (SELECT node_id, node_id FROM {node} UNION ALL SELECT u.node_id, n.parent_id FROM up u JOIN {node} n ON n.node_id = u.ancestor_id WHERE n.parent_id IS NOT NULL) SELECT node_id, ancestor_id FROM up",
    "trv_descend": "SELECT p.ancestor_id AS from_id, n.node_id FROM {path} p JOIN {node} n ON n.node_id = p.node_id WHERE p.distance = 1 OR (n.is_leaf = 1 AND p.distance = 0)",
    "trv_cluster_ancestors": "SELECT c.cluster_id, p.ancestor_id, count(*) AS times FROM {cluster} c JOIN {path} p ON p.node_id = c.node_id WHERE p.distance > 0 GROUP BY c.cluster_id, p.ancestor_id",
    "trv_lca_distance": "SELECT a.node_id AS leaf_a, b.node_id AS leaf_b, CAST(max(x.level) + max(y.level) - 2 * max(l.level) AS INTEGER) AS distance FROM {path} a JOIN {path} b ON b.ancestor_id = a.ancestor_id JOIN {node} x ON x.node_id = a.node_id AND x.is_leaf = 1 JOIN {node} y ON y.node_id = b.node_id AND y.is_leaf = 1 JOIN {node} l ON l.node_id = a.ancestor_id WHERE a.node_id < b.node_id GROUP BY a.node_id, b.node_id",
    "trv_split_feature": "SELECT node_id, feature FROM {node} WHERE parent_id IS NOT NULL",
    "trv_trim": "SELECT n.node_id FROM {node} n WHERE NOT EXISTS (SELECT 1 FROM {path} p JOIN (SELECT d.node_id FROM {doublet} d JOIN {node} k ON k.node_id = d.node_id WHERE k.parent_id IS NOT NULL GROUP BY d.node_id HAVING 1 - sum(d.own) / sum(d.parent) < 0.01) w ON w.node_id = p.ancestor_id WHERE p.node_id = n.node_id AND p.distance > 0)",
    "trv_derive_subset": "SELECT n.node_id, coalesce(k.population, 0) AS population FROM {node} n LEFT JOIN (SELECT m.node_id, count(*) AS population FROM {member} m JOIN {sample} s ON s.sample_id = m.sample_id WHERE s.label < 5 GROUP BY m.node_id) k ON k.node_id = n.node_id WHERE NOT EXISTS (SELECT 1 FROM {path} p JOIN {node} a ON a.node_id = p.ancestor_id LEFT JOIN (SELECT m.node_id, count(*) AS c FROM {member} m JOIN {sample} s ON s.sample_id = m.sample_id WHERE s.label < 5 GROUP BY m.node_id) z ON z.node_id = a.node_id LEFT JOIN (SELECT m.node_id, count(*) AS c FROM {member} m JOIN {sample} s ON s.sample_id = m.sample_id WHERE s.label < 5 GROUP BY m.node_id) y ON y.node_id = a.sister_id WHERE p.node_id = n.node_id AND a.parent_id IS NOT NULL AND (coalesce(z.c, 0) = 0 OR coalesce(y.c, 0) = 0))",
    "trv_plot_shares": "SELECT n.node_id, {r: p.population / CAST(sum(p.population) OVER (PARTITION BY n.tree_id, n.level) AS DOUBLE) :r} AS share FROM {node} n JOIN {pop} p ON p.node_id = n.node_id",
    "agg_node_population": "SELECT node_id, population FROM {pop}",
    "agg_node_mean": "SELECT node_id, feature_id, {r: mean :r} AS value FROM {nf}",
    "agg_node_median": "SELECT node_id, feature_id, {r: median :r} AS value FROM {nmed}",
    "agg_node_sse": "SELECT node_id, feature_id, {r: own :r} AS value FROM {doublet}",
    "agg_sse_doublet": "SELECT node_id, feature_id, {r: own :r} AS own, {r: parent :r} AS parent FROM {doublet}",
    "agg_cod": "SELECT node_id, {r: 1 - sum(own) / nullif(sum(parent), 0) :r} AS value FROM {doublet} GROUP BY node_id",
    "agg_error_ratio": "SELECT d.node_id, d.feature_id, {r: (d.own + 1) / (CASE WHEN n.parent_id IS NULL THEN d.own ELSE d.parent END + 1) :r} AS value FROM {doublet} d JOIN {node} n ON n.node_id = d.node_id",
    "agg_additive_mean": "SELECT node_id, feature_id, {r: gain :r} AS value FROM {gain}",
    "agg_additive_median": "SELECT n.node_id, a.feature_id, {r: a.median - coalesce(p.median, 0) :r} AS value FROM {node} n JOIN {nmed} a ON a.node_id = n.node_id LEFT JOIN {nmed} p ON p.node_id = n.parent_id AND p.feature_id = a.feature_id",
    "agg_partials": "SELECT g.node_id, g.feature_id, {r: CASE WHEN n.is_leaf = 1 THEN g.gain WHEN max(d.own) = 0 THEN 0 ELSE g.gain * sum(k.population * power(f.mean - k.mean, 2)) / max(d.own) END :r} AS value FROM {gain} g JOIN {node} n ON n.node_id = g.node_id JOIN {doublet} d ON d.node_id = g.node_id AND d.feature_id = g.feature_id JOIN {nf} f ON f.node_id = g.node_id AND f.feature_id = g.feature_id LEFT JOIN {node} c ON c.parent_id = g.node_id LEFT JOIN {nf} k ON k.node_id = c.node_id AND k.feature_id = g.feature_id GROUP BY g.node_id, g.feature_id, g.gain, n.is_leaf",
    "agg_residuals": "SELECT m.node_id, c.sample_id, {r: sum(abs(c.value - f.mean)) :r} AS mean_residual, {r: sum(abs(c.value - d.median)) :r} AS median_residual FROM {member} m JOIN {cell} c ON c.sample_id = m.sample_id JOIN {nf} f ON f.node_id = m.node_id AND f.feature_id = c.feature_id JOIN {nmed} d ON d.node_id = m.node_id AND d.feature_id = c.feature_id GROUP BY m.node_id, c.sample_id",
    "agg_dispersion": "SELECT m.node_id, c.sample_id, {r: sum(power(c.value - d.median, 2)) :r} AS value FROM {member} m JOIN {cell} c ON c.sample_id = m.sample_id JOIN {nmed} d ON d.node_id = m.node_id AND d.feature_id = c.feature_id GROUP BY m.node_id, c.sample_id",
    "agg_local_gain": "SELECT n.node_id, d.feature_id, {r: p.own - d.own :r} AS value FROM {node} n JOIN {doublet} d ON d.node_id = n.node_id JOIN {doublet} p ON p.node_id = n.parent_id AND p.feature_id = d.feature_id",
    "agg_absolute_gain": "SELECT d.node_id, d.feature_id, {r: r.own - d.own :r} AS value FROM {doublet} d JOIN {path} p ON p.node_id = d.node_id JOIN {node} n ON n.node_id = p.ancestor_id AND n.parent_id IS NULL JOIN {doublet} r ON r.node_id = n.node_id AND r.feature_id = d.feature_id",
    "agg_ssme": "SELECT c.feature_id, {r: sum(power(c.value - m.median, 2)) :r} AS value, {r: sum(abs(c.value - m.median)) :r} AS sme FROM {cell} c JOIN (SELECT feature_id, median(value) AS median FROM {cell} GROUP BY feature_id) m ON m.feature_id = c.feature_id GROUP BY c.feature_id",
    "agg_nonzero_mad": "SELECT c.feature_id, {r: median(abs(c.value - m.median)) :r} AS value FROM {cell} c JOIN (SELECT feature_id, median(value) AS median FROM {cell} WHERE value <> 0 GROUP BY feature_id) m ON m.feature_id = c.feature_id WHERE c.value <> 0 GROUP BY c.feature_id",
    "agg_jackknife": "SELECT feature_id, {r: var_pop(loo) * (max(n) - 1) :r} AS value FROM (SELECT feature_id, count(*) OVER (PARTITION BY feature_id) AS n, (sum(value * value) OVER (PARTITION BY feature_id) - value * value) / (count(*) OVER (PARTITION BY feature_id) - 1) AS loo FROM {cell}) q GROUP BY feature_id",
    "agg_weighted_corr": f"SELECT cluster_id, feature_a, feature_b, {{r: CASE WHEN feature_a = feature_b THEN 1 ELSE coalesce({CORR}, 0) END :r}} AS value FROM ({WCORR}) q",
    "agg_corr_matrix": f"SELECT feature_a, feature_b, {{r: c :r}} AS value FROM ({GLOBAL}) q",
    "agg_element_counts": "SELECT label, count(*) AS n FROM {sample} GROUP BY label",
    "agg_partition_mi": "SELECT a.node_id AS leaf_a, b.node_id AS leaf_b, {r: count(*) / max(t.n) * (ln(count(*)) - ln(max(x.population) * max(y.population)) + ln(max(t.n))) :r} AS value FROM {member} a JOIN {member} b ON b.sample_id = a.sample_id JOIN {node} k ON k.node_id = a.node_id AND k.is_leaf = 1 JOIN {node} l ON l.node_id = b.node_id AND l.is_leaf = 1 JOIN {pop} x ON x.node_id = a.node_id JOIN {pop} y ON y.node_id = b.node_id CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM {sample}) t GROUP BY a.node_id, b.node_id",
    "agg_arg_extremes": "SELECT feature_id, min_by(sample_id, value) AS lowest, max_by(sample_id, value) AS highest, {r: min(value) :r} AS low, {r: max(value) :r} AS high FROM {cell} GROUP BY feature_id",
    "win_valsort": "SELECT feature_id, sample_id, CAST(row_number() OVER (PARTITION BY feature_id ORDER BY value, sample_id) - 1 AS BIGINT) AS p FROM {cell}",
    "win_ranked_features": "SELECT node_id, feature_id, CAST(row_number() OVER (PARTITION BY node_id ORDER BY gain, feature_id) AS BIGINT) AS place FROM {gain}",
    "trn_bag": "SELECT node_id, sample_id, CASE WHEN place <= floor(0.66 * n) THEN 1 ELSE 0 END AS in_bag FROM {bag}",
    "trn_draw": "SELECT tree_id, draw, sample_id FROM {draw}",
    "trn_feature_draw": "SELECT n.node_id, g.draw, {hex8('7|in|', n.node_id, '|', g.draw)} % 64 AS in_feature, {hex8('7|out|', n.node_id, '|', g.draw)} % 64 AS out_feature FROM {node} n CROSS JOIN {draws} g WHERE g.draw < 20",
    "trn_split_guard": "SELECT n.node_id, CASE WHEN min(k.population) >= 3 AND count(*) = 2 THEN 1 ELSE 0 END AS may_split FROM {node} n JOIN {node} c ON c.parent_id = n.node_id JOIN {pop} k ON k.node_id = c.node_id GROUP BY n.node_id",
    "enc_sample": "SELECT sample_id, node_id FROM {member}",
    "enc_sister": "SELECT node_id, sample_id, 1 AS value FROM {member} UNION ALL SELECT node_id, sample_id, -1 FROM {sister_member}",
    "enc_factor": "SELECT n.node_id, c.cluster_id, CASE WHEN k.node_id IS NULL THEN 0 ELSE 1 END AS value FROM {node} n CROSS JOIN (SELECT DISTINCT cluster_id FROM {cluster}) c LEFT JOIN {cluster} k ON k.node_id = n.node_id AND k.cluster_id = c.cluster_id",
    "enc_sister_distance": f"SELECT node_a, node_b, {{r: 1 - (c + least(na, nb)) / (2.0 * greatest(na, nb)) :r}} AS value FROM ({NODE_PAIR}) q",
    "enc_jaccard": f"SELECT node_a, node_b, {{r: 1 - c / CAST(na + nb - c AS DOUBLE) :r}} AS value FROM ({NODE_PAIR}) q",
    "enc_cosine_distance": f"SELECT a AS node_a, b AS node_b, {{r: cosine :r}} AS value FROM ({DIST}) q",
    "enc_euclidean_distance": f"SELECT a AS node_a, b AS node_b, {{r: euclid :r}} AS value FROM ({DIST}) q",
    "enc_cityblock_distance": f"SELECT a AS node_a, b AS node_b, {{r: city :r}} AS value FROM ({DIST}) q",
    "enc_correlation_distance": f"SELECT a AS node_a, b AS node_b, {{r: correlation :r}} AS value FROM ({DIST}) q",
    "enc_cluster_means": "SELECT k.cluster_id, f.feature_id, {r: avg(f.mean) :r} AS mean, {r: avg(g.gain) :r} AS additive FROM {cluster} k JOIN {nf} f ON f.node_id = k.node_id JOIN {gain} g ON g.node_id = k.node_id AND g.feature_id = f.feature_id GROUP BY k.cluster_id, f.feature_id",
    "enc_cluster_domain_means": "SELECT k.cluster_id, f.feature_id, {r: avg(f.mean) :r} AS mean FROM (SELECT cluster_id, node_id FROM {cluster} UNION ALL SELECT c.cluster_id, n.sister_id FROM {cluster} c JOIN {node} n ON n.node_id = c.node_id WHERE n.sister_id IS NOT NULL) k JOIN {nf} f ON f.node_id = k.node_id GROUP BY k.cluster_id, f.feature_id",
    "prd_route": "SELECT m.sample_id, m.node_id, n.level FROM {member} m JOIN {node} n ON n.node_id = m.node_id",
    "prd_leaves": "SELECT m.sample_id, n.tree_id, m.node_id FROM {member} m JOIN {node} n ON n.node_id = m.node_id WHERE n.is_leaf = 1",
    "prd_mean": "SELECT sample_id, feature_id, {r: predicted :r} AS predicted FROM {leafmean}",
    "prd_additive": "SELECT m.sample_id, g.feature_id, {r: sum(g.gain) / max(t.n) :r} AS predicted FROM {member} m JOIN {gain} g ON g.node_id = m.node_id CROSS JOIN (SELECT count(DISTINCT tree_id) AS n FROM {node}) t GROUP BY m.sample_id, g.feature_id",
    "prd_residuals": "SELECT sample_id, feature_id, {r: residual :r} AS residual, {r: null_residual :r} AS null_residual FROM {residual}",
    "prd_observed_means": "SELECT n.node_id, f.feature_id, {r: coalesce(f.mean, 0) :r} AS mean FROM {node} n LEFT JOIN (SELECT m.node_id, c.feature_id, avg(c.value) AS mean FROM {member} m JOIN {cell} c ON c.sample_id = m.sample_id WHERE c.sample_id % 2 = 1 GROUP BY m.node_id, c.feature_id) f ON f.node_id = n.node_id",
    "prd_observed_marginal": "SELECT n.node_id, f.feature_id, {r: CASE WHEN n.parent_id IS NULL THEN 0 ELSE coalesce(o.mean - p.mean, 0) END :r} AS value FROM {node} n CROSS JOIN (SELECT DISTINCT feature_id FROM {cell}) f LEFT JOIN " + OTHER + " o ON o.node_id = n.node_id AND o.feature_id = f.feature_id LEFT JOIN " + OTHER + " p ON p.node_id = n.parent_id AND p.feature_id = f.feature_id",
    "prd_factor_matrix": "SELECT sample_id, cluster_id, {r: CASE WHEN cluster_id = 0 THEN 1 ELSE (own - sister) / n END :r} AS value FROM {score}",
    "prd_log_sister": "SELECT sample_id, cluster_id, {r: ln((own + 1) / (sister + 1)) :r} AS value FROM {score}",
    "prd_sample_cluster": "SELECT sample_id, label AS cluster_id FROM (SELECT sample_id, label, row_number() OVER (PARTITION BY sample_id ORDER BY share DESC, label) AS place FROM (SELECT m.sample_id, q.label, round(sum(q.share), 9) AS share FROM {member} m JOIN (SELECT n.node_id, s.label, count(*) / CAST(max(p.population) AS DOUBLE) AS share FROM {node} n JOIN {member} m ON m.node_id = n.node_id JOIN {sample} s ON s.sample_id = m.sample_id JOIN {pop} p ON p.node_id = n.node_id WHERE n.is_leaf = 1 GROUP BY n.node_id, s.label) q ON q.node_id = m.node_id GROUP BY m.sample_id, q.label) z) y WHERE place = 1",
    "met_node_sample_sq": "SELECT m.node_id, m.sample_id, {r: sum(power(c.value - f.mean, 2)) :r} AS value FROM {member} m JOIN {cell} c ON c.sample_id = m.sample_id JOIN {nf} f ON f.node_id = m.node_id AND f.feature_id = c.feature_id GROUP BY m.node_id, m.sample_id",
    "met_node_feature_sq": "SELECT node_id, feature_id, {r: own :r} AS value FROM {doublet}",
    "met_node_mse": "SELECT node_id, {r: sum(own) / sum(n) :r} AS value FROM {doublet} GROUP BY node_id",
    "met_node_fraction": "SELECT n.node_id, {r: CASE WHEN n.parent_id IS NULL THEN 1 ELSE a.population / CAST(p.population AS DOUBLE) END :r} AS value FROM {node} n JOIN {pop} a ON a.node_id = n.node_id LEFT JOIN {pop} p ON p.node_id = n.parent_id",
    "met_factor_fvu": "SELECT k.cluster_id, {r: sum(d.own) / sum(d.parent) :r} AS fvu, {r: 1 - sum(d.own) / sum(d.parent) :r} AS cod FROM {cluster} k JOIN {doublet} d ON d.node_id = k.node_id GROUP BY k.cluster_id",
    "met_factor_feature_error": "SELECT k.cluster_id, d.feature_id, {r: sum(d.own) :r} AS own, {r: sum(d.parent) :r} AS parent FROM {cluster} k JOIN {doublet} d ON d.node_id = k.node_id GROUP BY k.cluster_id, d.feature_id",
    "met_factor_mse_iqr": "SELECT k.cluster_id, {r: avg(e.mse) :r} AS mean, {r: var_pop(e.mse) :r} AS variance, {r: {pct(e.mse; 0.95)} - {pct(e.mse; 0.05)} :r} AS spread FROM {cluster} k JOIN (SELECT node_id, sum(own) / sum(n) AS mse FROM {doublet} GROUP BY node_id) e ON e.node_id = k.node_id GROUP BY k.cluster_id",
    "met_jackknife_factor": "SELECT cluster_id, {r: avg(loo) :r} AS mean, {r: var_pop(loo) * (max(n) - 1) :r} AS variance FROM (SELECT k.cluster_id, count(*) OVER (PARTITION BY k.cluster_id) AS n, (sum(e.mse) OVER (PARTITION BY k.cluster_id) - e.mse) / (count(*) OVER (PARTITION BY k.cluster_id) - 1) AS loo FROM {cluster} k JOIN (SELECT node_id, sum(own) / sum(n) AS mse FROM {doublet} GROUP BY node_id) e ON e.node_id = k.node_id) q GROUP BY cluster_id",
    "met_feature_mse": "SELECT feature_id, {r: avg(residual * residual) :r} AS value FROM {residual} GROUP BY feature_id",
    "met_jackknife_var": "SELECT feature_id, {r: var_pop(loo) * (max(n) - 1) :r} AS value FROM (SELECT feature_id, count(*) OVER (PARTITION BY feature_id) AS n, (sum(residual * residual) OVER (PARTITION BY feature_id) - residual * residual) / (count(*) OVER (PARTITION BY feature_id) - 1) AS loo FROM {residual}) q GROUP BY feature_id",
    "met_remaining_error": "SELECT feature_id, {r: sum(residual * residual) / sum(null_residual * null_residual) :r} AS value FROM {residual} GROUP BY feature_id",
    "met_report_total": "SELECT {r: sum(residual * residual) / sum(null_residual * null_residual) :r} AS fvu FROM {residual}",
    "met_report_feature": "SELECT feature_id, {r: (sum(residual * residual) + 1) / (sum(null_residual * null_residual) + 1) :r} AS value FROM {residual} GROUP BY feature_id",
    "met_report_sample": "SELECT sample_id, {r: (sum(residual * residual) + 1) / (sum(null_residual * null_residual) + 1) :r} AS value FROM {residual} GROUP BY sample_id",
    "cmp_rank_sum": f"SELECT feature_id, {{r: sum(CASE WHEN other = 0 THEN r END) :r}} AS rank_sum, {{r: sum(CASE WHEN other = 0 THEN r END) - sum(1 - other) * (sum(1 - other) + 1) / 2.0 :r}} AS u FROM {RANKED} q GROUP BY feature_id",
    "cmp_fraction_mwu": "SELECT cluster_id, {r: sum(CASE WHEN side = 0 THEN r END) - sum(1 - side) * (sum(1 - side) + 1) / 2.0 :r} AS u FROM (SELECT cluster_id, side, rank() OVER (PARTITION BY cluster_id ORDER BY f) + (count(*) OVER (PARTITION BY cluster_id, f) - 1) / 2.0 AS r FROM (SELECT k.cluster_id, a.side, round(a.c / CAST(p.c AS DOUBLE), 9) AS f FROM {cluster} k JOIN {node} n ON n.node_id = k.node_id JOIN (SELECT node_id, sample_id % 2 AS side, count(*) AS c FROM {member} GROUP BY node_id, sample_id % 2) a ON a.node_id = n.node_id JOIN (SELECT node_id, sample_id % 2 AS side, count(*) AS c FROM {member} GROUP BY node_id, sample_id % 2) p ON p.node_id = coalesce(n.parent_id, n.node_id) AND p.side = a.side) w) q GROUP BY cluster_id",
    "cmp_ks": f"SELECT feature_id, {{r: max(abs(a - b)) :r}} AS ks FROM (SELECT feature_id, sum(1 - other) OVER (PARTITION BY feature_id ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(sum(1 - other) OVER (PARTITION BY feature_id) AS DOUBLE) AS a, sum(other) OVER (PARTITION BY feature_id ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(sum(other) OVER (PARTITION BY feature_id) AS DOUBLE) AS b FROM {SIGN} q) z GROUP BY feature_id",
    "cmp_symmetric_kl": "SELECT cluster_id, {r: sum((p - q) * (ln(p) - ln(q))) :r} AS kl FROM (SELECT cluster_id, bin, (sum(1 - side) + 1) / CAST(sum(sum(1 - side)) OVER (PARTITION BY cluster_id) + count(*) OVER (PARTITION BY cluster_id) AS DOUBLE) AS p, (sum(side) + 1) / CAST(sum(sum(side)) OVER (PARTITION BY cluster_id) + count(*) OVER (PARTITION BY cluster_id) AS DOUBLE) AS q FROM (SELECT cluster_id, floor(((own - sister) / n + 1) / 0.2) AS bin, sample_id % 2 AS side FROM {score}) w GROUP BY cluster_id, bin) z GROUP BY cluster_id",
    "cmp_marginals": "SELECT k.cluster_id, f.feature_id, {r: avg(CASE WHEN side = 0 THEN f.mean - p.mean END) :r} AS own, {r: avg(CASE WHEN side = 1 THEN f.mean - p.mean END) :r} AS other FROM {cluster} k JOIN {node} n ON n.node_id = k.node_id JOIN (SELECT m.node_id, c.feature_id, c.sample_id % 2 AS side, avg(c.value) AS mean FROM {member} m JOIN {cell} c ON c.sample_id = m.sample_id GROUP BY m.node_id, c.feature_id, c.sample_id % 2) f ON f.node_id = n.node_id JOIN (SELECT m.node_id, c.feature_id, c.sample_id % 2 AS s2, avg(c.value) AS mean FROM {member} m JOIN {cell} c ON c.sample_id = m.sample_id GROUP BY m.node_id, c.feature_id, c.sample_id % 2) p ON p.node_id = n.parent_id AND p.feature_id = f.feature_id AND p.s2 = f.side GROUP BY k.cluster_id, f.feature_id",
    "cmp_cluster_freq": "SELECT label AS cluster_id, sum(1 - sample_id % 2) AS own, sum(sample_id % 2) AS other FROM {sample} GROUP BY label",
    "cmp_mse_delta_z": "SELECT feature_id, {r: (b - a) / nullif(sqrt(va + vb), 0) :r} AS z FROM (SELECT feature_id, avg(CASE WHEN sample_id % 2 = 0 THEN residual * residual END) AS a, avg(CASE WHEN sample_id % 2 = 1 THEN residual * residual END) AS b, var_pop(CASE WHEN sample_id % 2 = 0 THEN residual * residual END) / (sum(1 - sample_id % 2) - 1) AS va, var_pop(CASE WHEN sample_id % 2 = 1 THEN residual * residual END) / (sum(sample_id % 2) - 1) AS vb FROM {residual} GROUP BY feature_id) q",
    "cmp_cod_delta": "SELECT feature_id, {r: sum(CASE WHEN sample_id % 2 = 0 THEN residual * residual END) / sum(CASE WHEN sample_id % 2 = 0 THEN null_residual * null_residual END) - sum(CASE WHEN sample_id % 2 = 1 THEN residual * residual END) / sum(CASE WHEN sample_id % 2 = 1 THEN null_residual * null_residual END) :r} AS delta FROM {residual} GROUP BY feature_id",
    "cmp_factor_means": "SELECT k.cluster_id, f.node_id, {r: sqrt(sum(power(f.mean - c.a, 2))) :r} AS distance FROM {cluster} k JOIN {nf} f ON f.node_id = k.node_id JOIN " + CHANGE + " c ON c.cluster_id = k.cluster_id AND c.feature_id = f.feature_id GROUP BY k.cluster_id, f.node_id",
    "knn_exact": f"SELECT a, b, place FROM (SELECT a, b, CAST(row_number() OVER (PARTITION BY a ORDER BY round(euclid, 9), b) AS BIGINT) AS place FROM ({DIST}) q) z WHERE place <= 5",
    "knn_double": f"SELECT a, b, place FROM (SELECT a, b, CAST(row_number() OVER (PARTITION BY a ORDER BY round((cosine + s) / 2, 9), b) AS BIGINT) AS place FROM ({DIST}) q JOIN (SELECT node_a, node_b, 1 - (c + least(na, nb)) / (2.0 * greatest(na, nb)) AS s FROM ({NODE_PAIR}) w) t ON t.node_a = q.a AND t.node_b = q.b) z WHERE place <= 5",
    "clu_propagate": "SELECT node_id, cluster_id FROM {split_label}",
    "clu_external_labels": "SELECT sample_id, label AS cluster_id FROM {sample}",
    "clu_samples_by_leaf_cluster": "SELECT sample_id, cluster_id FROM (SELECT sample_id, cluster_id, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, cluster_id) AS place FROM (SELECT m.sample_id, l.cluster_id, round(count(*) / CAST(max(k.n) AS DOUBLE), 9) AS s FROM {member} m JOIN {node} n ON n.node_id = m.node_id AND n.is_leaf = 1 JOIN {split_label} l ON l.node_id = n.node_id JOIN (SELECT b.cluster_id, count(*) AS n FROM {split_label} b JOIN {node} d ON d.node_id = b.node_id AND d.is_leaf = 1 GROUP BY b.cluster_id) k ON k.cluster_id = l.cluster_id GROUP BY m.sample_id, l.cluster_id) q) z WHERE place = 1",
    "clu_terminal_factor": "SELECT sample_id, cluster_id FROM (SELECT sample_id, cluster_id, row_number() OVER (PARTITION BY sample_id ORDER BY c DESC, cluster_id) AS place FROM (SELECT m.sample_id, l.cluster_id, count(*) AS c FROM {member} m JOIN {node} n ON n.node_id = m.node_id AND n.is_leaf = 1 JOIN {split_label} l ON l.node_id = n.node_id GROUP BY m.sample_id, l.cluster_id) q) z WHERE place = 1",
    "clu_within_share": f"SELECT {{r: sum(CASE WHEN x.cluster_id = y.cluster_id THEN 1.0 ELSE 0.0 END) / count(*) :r}} AS within_share FROM (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(euclid, 9), b) AS place FROM ({DIST}) q) e WHERE place <= 5) g JOIN {{split_label}} x ON x.node_id = g.a JOIN {{split_label}} y ON y.node_id = g.b",
    "fac_sample_scores": "SELECT cluster_id, sample_id, own AS n, {r: own / (n + 1) :r} AS score FROM {score}",
    "fac_sister_scores": "SELECT cluster_id, sample_id, {r: (own - sister) / n :r} AS value FROM {score}",
    "fac_log_sister": "SELECT cluster_id, sample_id, {r: ln((own + 1) / (sister + 1)) :r} AS value FROM {score}",
    "fac_change_abs": f"SELECT cluster_id, feature_id, {{r: own - other :r}} AS value FROM ({PARENTS}) q",
    "fac_change_sister": f"SELECT cluster_id, feature_id, {{r: own - other :r}} AS value FROM ({SISTERS}) q",
    "fac_change_log2": f"SELECT cluster_id, feature_id, {{r: ln(own / other) / ln(2) :r}} AS value FROM ({PARENTS}) q WHERE own > 0 AND other > 0",
    "fac_ranked_additive": "SELECT cluster_id, feature_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY round(avg(g.gain), 9), feature_id) AS BIGINT) AS place FROM {cluster} k JOIN {gain} g ON g.node_id = k.node_id GROUP BY cluster_id, feature_id",
    "fac_important_features": f"SELECT cluster_id, feature_id FROM (SELECT cluster_id, feature_id, row_number() OVER (PARTITION BY cluster_id ORDER BY round(own - other, 9), feature_id) AS low, row_number() OVER (PARTITION BY cluster_id ORDER BY round(own - other, 9) DESC, feature_id) AS high FROM ({SISTERS}) q) z WHERE low <= 3 OR high <= 3",
    "fac_coordinates": "SELECT cluster_id, {r: sum(s * s * a.value) / nullif(sum(s * s), 0) :r} AS x, {r: sum(s * s * b.value) / nullif(sum(s * s), 0) :r} AS y FROM (SELECT cluster_id, sample_id, (own - sister) / n AS s FROM {score}) q JOIN {cell} a ON a.sample_id = q.sample_id AND a.feature_id = 0 JOIN {cell} b ON b.sample_id = q.sample_id AND b.feature_id = 1 GROUP BY cluster_id",
    "fac_error_ratio": "SELECT q.cluster_id, c.feature_id, {r: (sum(s * power(c.value - o.mean, 2)) + 1) / (sum(s * power(c.value - g.mean, 2)) + 1) :r} AS value FROM (SELECT cluster_id, sample_id, own / (n + 1) AS s FROM {score}) q JOIN {cell} c ON c.sample_id = q.sample_id JOIN (SELECT k.cluster_id, f.feature_id, avg(f.mean) AS mean FROM {cluster} k JOIN {nf} f ON f.node_id = k.node_id GROUP BY k.cluster_id, f.feature_id) o ON o.cluster_id = q.cluster_id AND o.feature_id = c.feature_id JOIN (SELECT k.cluster_id, f.feature_id, avg(f.mean) AS mean FROM {cluster} k JOIN {node} n ON n.node_id = k.node_id JOIN {nf} f ON f.node_id = coalesce(n.parent_id, n.node_id) GROUP BY k.cluster_id, f.feature_id) g ON g.cluster_id = q.cluster_id AND g.feature_id = c.feature_id GROUP BY q.cluster_id, c.feature_id",
    "fac_strict_error": "SELECT k.cluster_id, d.feature_id, {r: (sum(d.own) + 1) / (sum(d.parent) + 1) :r} AS value FROM {cluster} k JOIN {node} n ON n.node_id = k.node_id AND n.parent_id IS NOT NULL JOIN {doublet} d ON d.node_id = k.node_id GROUP BY k.cluster_id, d.feature_id",
    "fac_local_minus_global": f"SELECT q.cluster_id, q.feature_a, q.feature_b, {{r: CASE WHEN q.feature_a = q.feature_b THEN 0 ELSE coalesce({CORR}, 0) - g.c END :r}} AS value FROM ({WCORR}) q JOIN ({GLOBAL}) g ON g.feature_a = q.feature_a AND g.feature_b = q.feature_b",
    "fac_odds_ratio": "SELECT a.i AS cluster_id, a.j AS downstream, {r: (1 + a.d) / CAST(1 + a.s AS DOUBLE) :r} AS value FROM (SELECT k.i, t.j, count(CASE WHEN e.node_id IS NOT NULL THEN 1 END) AS d, max(coalesce(z.s, 0)) AS s FROM (SELECT DISTINCT cluster_id AS i FROM {cluster} WHERE cluster_id > 0) k CROSS JOIN (SELECT DISTINCT cluster_id AS j FROM {cluster}) t LEFT JOIN (SELECT c.cluster_id, p.node_id, l.cluster_id AS lab FROM {cluster} c JOIN {path} p ON p.ancestor_id = c.node_id AND p.distance > 0 JOIN {split_label} l ON l.node_id = p.node_id) e ON e.cluster_id = k.i AND e.lab = t.j LEFT JOIN (SELECT c.cluster_id, l.cluster_id AS lab, count(*) AS s FROM {cluster} c JOIN {node} n ON n.node_id = c.node_id JOIN {path} p ON p.ancestor_id = n.sister_id JOIN {split_label} l ON l.node_id = p.node_id GROUP BY c.cluster_id, l.cluster_id) z ON z.cluster_id = k.i AND z.lab = t.j GROUP BY k.i, t.j) a",
    "fac_mean_level": "SELECT k.cluster_id, {r: avg(n.level) :r} AS level, {r: avg(p.population) :r} AS population FROM {cluster} k JOIN {node} n ON n.node_id = k.node_id JOIN {pop} p ON p.node_id = k.node_id GROUP BY k.cluster_id",
    "fac_sample_cluster_frequency": "SELECT k.cluster_id, s.label, count(*) AS n FROM {cluster} k JOIN {member} m ON m.node_id = k.node_id JOIN {sample} s ON s.sample_id = m.sample_id GROUP BY k.cluster_id, s.label",
    "smp_mean": "SELECT s.label AS cluster_id, c.feature_id, {r: avg(c.value) :r} AS value FROM {cell} c JOIN {sample} s ON s.sample_id = c.sample_id GROUP BY s.label, c.feature_id",
    "smp_median": "SELECT s.label AS cluster_id, c.feature_id, {r: median(c.value) :r} AS value FROM {cell} c JOIN {sample} s ON s.sample_id = c.sample_id GROUP BY s.label, c.feature_id",
    "smp_increased": "SELECT s.label AS cluster_id, c.feature_id, {r: avg(c.value) - max(g.m) :r} AS value FROM {cell} c JOIN {sample} s ON s.sample_id = c.sample_id CROSS JOIN (SELECT avg(value) AS m FROM {cell}) g GROUP BY s.label, c.feature_id",
    "smp_leaf_counts": "SELECT s.label AS cluster_id, m.node_id, count(*) AS n FROM {member} m JOIN {node} n ON n.node_id = m.node_id AND n.is_leaf = 1 JOIN {sample} s ON s.sample_id = m.sample_id GROUP BY s.label, m.node_id",
    "con_transitions": "SELECT parent, child, k AS value FROM (" + TRANSITION + ") q",
    "con_directional": "SELECT a.cluster_id AS upstream, b.cluster_id AS downstream, count(*) AS value FROM {path} p JOIN {split_label} a ON a.node_id = p.ancestor_id JOIN {split_label} b ON b.node_id = p.node_id WHERE p.distance > 0 GROUP BY a.cluster_id, b.cluster_id",
    "con_likely_parent": LIKELY,
    "con_likely_tree": "WITH RECURSIVE walk(cluster_id, depth) AS (SELECT 0, 0 UNION ALL SELECT e.child, w.depth + 1 FROM walk w JOIN (" + LIKELY + ") e ON e.parent = w.cluster_id) SELECT cluster_id, depth FROM walk",
    "con_affinity_samples": f"SELECT parent, child, {{r: affinity :r}} AS value FROM ({AFFINITY}) q",
    "con_path_covariance": "SELECT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, {r: sum(CASE WHEN x.node_id = y.node_id THEN 1 ELSE 0 END) / max(t.n) - max(a.k) * max(b.k) / (max(t.n) * max(t.n)) :r} AS value FROM (SELECT cluster_id, count(*) AS k FROM {cluster} GROUP BY cluster_id) a CROSS JOIN (SELECT cluster_id, count(*) AS k FROM {cluster} GROUP BY cluster_id) b JOIN {cluster} x ON x.cluster_id = a.cluster_id JOIN {cluster} y ON y.cluster_id = b.cluster_id CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM {node}) t GROUP BY a.cluster_id, b.cluster_id",
    "pre_normalize_log1p": f"SELECT sample_id, feature_id, {{r: v :r}} AS value FROM ({NORM}) q",
    "pre_high_dispersion": f"SELECT feature_id FROM (SELECT feature_id, row_number() OVER (ORDER BY round(var_pop(v) / avg(v), 9) DESC, feature_id) AS place FROM ({NORM}) q GROUP BY feature_id) z WHERE place <= 20",
    "pre_scaled": "SELECT c.sample_id, c.feature_id, {r: (c.value - g.m) / nullif(g.s, 0) :r} AS value FROM {cell} c JOIN (SELECT feature_id, avg(value) AS m, stddev_pop(value) AS s FROM {cell} GROUP BY feature_id) g ON g.feature_id = c.feature_id",
    "nb_train_test": "SELECT sample_id, CASE WHEN {hex8('7|split|', sample_id)} % 10 >= 1 THEN 1 ELSE 0 END AS train FROM {sample}",
    "nb_selected_features": "SELECT feature_id FROM {residual} GROUP BY feature_id HAVING (sum(residual * residual) + 1) / (sum(null_residual * null_residual) + 1) < 0.9",
    "nb_calinski": f"SELECT {{r: (b / (k - 1)) / (w / (n - k)) :r}} AS value FROM (SELECT sum(c.n * power(c.mean - g.m, 2)) AS b FROM ({CH}) c JOIN (SELECT feature_id, avg(value) AS m FROM {{cell}} GROUP BY feature_id) g ON g.feature_id = c.feature_id) x CROSS JOIN (SELECT sum(power(e.value - c.mean, 2)) AS w FROM {{cell}} e JOIN {{sample}} s ON s.sample_id = e.sample_id JOIN ({CH}) c ON c.feature_id = e.feature_id AND c.label = s.label) y CROSS JOIN (SELECT count(*) AS n, count(DISTINCT label) AS k FROM {{sample}}) z",
    "nb_contingency": "SELECT s.label, m.node_id, count(*) AS n FROM {sample} s JOIN {member} m ON m.sample_id = s.sample_id JOIN {node} k ON k.node_id = m.node_id WHERE k.is_leaf = 1 AND k.tree_id = 0 GROUP BY s.label, m.node_id",
    "nb_local_regression": "SELECT q.cluster_id, {r: (count(*) * sum(a.value * b.value) - sum(a.value) * sum(b.value)) / nullif(count(*) * sum(a.value * a.value) - sum(a.value) * sum(a.value), 0) :r} AS slope, {r: corr(a.value, b.value) :r} AS r FROM (SELECT cluster_id, sample_id FROM {score} WHERE (own - sister) / n > 0.3) q JOIN {cell} a ON a.sample_id = q.sample_id AND a.feature_id = 0 JOIN {cell} b ON b.sample_id = q.sample_id AND b.feature_id = 1 GROUP BY q.cluster_id HAVING count(*) > 2 AND var_pop(b.value) > 0",
    "nb_prediction_fit": "SELECT feature_id, {r: avg(residual * residual) :r} AS mse, {r: avg(abs(residual)) :r} AS mae, {r: corr(value, value - residual) :r} AS r FROM {residual} GROUP BY feature_id",
    "src_auto_parameters": "SELECT CAST(floor(64 / log10(64.0)) AS BIGINT) AS features, CAST(CASE WHEN n < 10 THEN n WHEN n < 1000 THEN 2 * floor(n / 3.0) WHEN n < 5000 THEN floor(n / 2.0) ELSE floor(n / 4.0) END AS BIGINT) AS draws FROM (SELECT count(*) AS n FROM {sample}) q",
    "src_header": "SELECT feature_id, CASE WHEN n = 0 THEN raw ELSE concat(raw, n) END AS name FROM (SELECT feature_id, raw, row_number() OVER (PARTITION BY raw ORDER BY feature_id) - 1 AS n FROM (SELECT DISTINCT feature_id, concat('g', feature_id % 7) AS raw FROM {cell}) q) z",
    "snk_tsv": "SELECT sample_id, concat(sample_id, chr(9), label) AS line FROM {sample}",
}



def run(name: str, spark, sf_dir: str):
    """The plan ``name`` over the fixture forest on the tables in ``sf_dir``."""
    return fixture_relations(spark, sf_dir).sql(PLANS[name])


#: Plans as texts; where an operator is a function of its own, the query calls it and the text is its twin only.
QUERIES = {name: partial(run, name) for name in PLANS} | applied.QUERIES
ORACLE_SQL = {name: duck(body) for name, body in (PLANS | TWINS).items()}
