"""The relations that plans read, as Spark views and as DuckDB common table expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.forest import Forest, fixture
from ..operators.order import row_numbers
from ..sources.matrix import cells, embeddings

#: Draws of a node, from its samples: as many as the parameters choose for the table.
DRAWS = "CASE WHEN count(*) < 10 THEN count(*) WHEN count(*) < 1000 THEN 2 * (count(*) // 3) WHEN count(*) < 5000 THEN count(*) // 2 ELSE count(*) // 4 END"

_NODES = [(7 * t + i, t, p if p is None else 7 * t + p, s if s is None else 7 * t + s, lv, lr, leaf, f1 if f1 is None else t, d1, f2 if f2 is None else f2 + 2 * t, d2) for t in range(3) for i, p, s, lv, lr, leaf, f1, d1, f2, d2 in [
    (0, 4, 1, 2, 0, 1, 0, 0, 4, 0), (1, 4, 0, 2, 1, 1, 0, 0, 4, 1), (2, 5, 3, 2, 0, 1, 0, 1, 5, 0), (3, 5, 2, 2, 1, 1, 0, 1, 5, 1),
    (4, 6, 5, 1, 0, 0, 0, 0, None, None), (5, 6, 4, 1, 1, 0, 0, 1, None, None), (6, None, None, 0, 0, 0, None, None, None, None),
]]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) for v in r) + ")" for r in rows)


#: Clusters of the fixture's nodes.
CLUSTERS = [(c, 7 * t + i) for c, i in ((0, 6), (1, 4), (2, 5), (3, 0), (4, 3)) for t in range(3)]

#: Relations derived from the basic ones, the same text for both engines; in order of need.
DERIVED = {
    "nf": "SELECT m.node_id, c.feature_id, count(*) AS population, avg(c.value) AS mean FROM {member} m JOIN {cell} c ON m.sample_id = c.sample_id GROUP BY m.node_id, c.feature_id",
    "nmed": "SELECT m.node_id, c.feature_id, median(c.value) AS median FROM {member} m JOIN {cell} c ON m.sample_id = c.sample_id GROUP BY m.node_id, c.feature_id",
    "pop": "SELECT node_id, count(*) AS population FROM {member} GROUP BY node_id",
    "doublet": """SELECT m.node_id, c.feature_id, count(*) AS n, sum(power(c.value - a.mean, 2)) AS own, sum(power(c.value - coalesce(p.mean, 0), 2)) AS parent
        FROM {member} m JOIN {cell} c ON m.sample_id = c.sample_id JOIN {node} n ON n.node_id = m.node_id
        JOIN {nf} a ON a.node_id = m.node_id AND a.feature_id = c.feature_id
        LEFT JOIN {nf} p ON p.node_id = n.parent_id AND p.feature_id = c.feature_id GROUP BY m.node_id, c.feature_id""",
    "gain": """SELECT n.node_id, a.feature_id, a.mean - coalesce(p.mean, 0) AS gain FROM {node} n JOIN {nf} a ON a.node_id = n.node_id
        LEFT JOIN {nf} p ON p.node_id = n.parent_id AND p.feature_id = a.feature_id""",
    "leafmean": """SELECT m.sample_id, f.feature_id, avg(f.mean) AS predicted FROM {member} m JOIN {node} n ON n.node_id = m.node_id AND n.is_leaf = 1
        JOIN {nf} f ON f.node_id = m.node_id GROUP BY m.sample_id, f.feature_id""",
    "residual": "SELECT c.sample_id, c.feature_id, c.value, c.value - p.predicted AS residual, c.value - g.mean AS null_residual FROM {cell} c JOIN {leafmean} p ON p.sample_id = c.sample_id AND p.feature_id = c.feature_id JOIN (SELECT feature_id, avg(value) AS mean FROM {cell} GROUP BY feature_id) g ON g.feature_id = c.feature_id",
    "split_label": "SELECT p.node_id, min_by(c.cluster_id, p.distance) AS cluster_id FROM {path} p JOIN {cluster} c ON c.node_id = p.ancestor_id GROUP BY p.node_id",
    "sister_member": "SELECT n.node_id, m.sample_id FROM {node} n JOIN {member} m ON m.node_id = n.sister_id",
    "score": """SELECT k.cluster_id, s.sample_id, CAST(coalesce(o.c, 0) AS DOUBLE) AS own, CAST(coalesce(t.c, 0) AS DOUBLE) AS sister, CAST(k.n AS DOUBLE) AS n
        FROM (SELECT cluster_id, count(*) AS n FROM {cluster} GROUP BY cluster_id) k CROSS JOIN {sample} s
        LEFT JOIN (SELECT cluster_id, sample_id, count(*) AS c FROM {cluster} JOIN {member} USING (node_id) GROUP BY cluster_id, sample_id) o ON o.cluster_id = k.cluster_id AND o.sample_id = s.sample_id
        LEFT JOIN (SELECT cluster_id, sample_id, count(*) AS c FROM {cluster} JOIN {sister_member} USING (node_id) GROUP BY cluster_id, sample_id) t ON t.cluster_id = k.cluster_id AND t.sample_id = s.sample_id""",
    "bag": "SELECT n.tree_id, n.parent_id, m.node_id, m.sample_id, row_number() OVER (PARTITION BY m.node_id ORDER BY {hex8('7|bag|', m.node_id, '|', m.sample_id)}, m.sample_id) AS place, count(*) OVER (PARTITION BY m.node_id) AS n FROM {member} m JOIN {node} n ON n.node_id = m.node_id",
    "inbag": "SELECT tree_id, sample_id, place - 1 AS place, floor(0.66 * n) AS k FROM {bag} WHERE parent_id IS NULL AND place <= floor(0.66 * n)",
    "draw": "SELECT d.tree_id, d.draw, b.sample_id FROM (SELECT t.tree_id, g.draw, {hex8('7|draw|', t.tree_id, '|', g.draw)} AS h FROM (SELECT DISTINCT tree_id FROM {node}) t CROSS JOIN {draws} g) d JOIN {inbag} b ON b.tree_id = d.tree_id AND b.place = d.h % CAST(b.k AS BIGINT)",
}

#: Of these, what Spark takes from sums of whole vectors by node (``stat``: rows, sum and sum of squares); the twins keep to the definitions above.
FROM_SUMS = {
    "nf": "SELECT node_id, feature_id, n AS population, s / n AS mean FROM {stat}",
    "pop": "SELECT node_id, n AS population FROM {stat} WHERE feature_id = 0",
    "doublet": """SELECT a.node_id, a.feature_id, a.n, greatest(0D, a.q - a.s * a.s / a.n) AS own, greatest(0D, a.q - 2 * coalesce(p.s / p.n, 0) * a.s + a.n * power(coalesce(p.s / p.n, 0), 2)) AS parent
        FROM {stat} a JOIN {node} k ON k.node_id = a.node_id LEFT JOIN {stat} p ON p.node_id = k.parent_id AND p.feature_id = a.feature_id""",
}

DUCK_BASE = {
    "sample": "SELECT vec_id AS sample_id, embedding::DOUBLE[] AS x, label FROM embeddings",
    "cell": "SELECT sample_id, (f.f)::INTEGER AS feature_id, x[f.f + 1] AS value FROM {sample}, range(64) f(f)",
    "node": f"SELECT node_id::BIGINT AS node_id, tree_id::INTEGER AS tree_id, parent_id::BIGINT AS parent_id, sister_id::BIGINT AS sister_id, level::INTEGER AS level, lr::INTEGER AS lr, is_leaf::INTEGER AS is_leaf, f1, d1, f2, d2, coalesce(f2, f1)::INTEGER AS feature FROM (VALUES {_values(_NODES)}) v(node_id, tree_id, parent_id, sister_id, level, lr, is_leaf, f1, d1, f2, d2)",
    "path": "SELECT node_id, node_id AS ancestor_id, 0 AS distance FROM {node} UNION ALL SELECT node_id, parent_id, 1 FROM {node} WHERE parent_id IS NOT NULL UNION ALL SELECT a.node_id, b.parent_id, 2 FROM {node} a JOIN {node} b ON a.parent_id = b.node_id WHERE b.parent_id IS NOT NULL",
    "member": "SELECT n.node_id, s.sample_id FROM {node} n, {sample} s WHERE (n.f1 IS NULL OR (s.x[n.f1 + 1] > 0) = (n.d1 = 1)) AND (n.f2 IS NULL OR (s.x[n.f2 + 1] > 0) = (n.d2 = 1))",
    "cluster": f"SELECT cluster_id::INTEGER AS cluster_id, node_id::BIGINT AS node_id FROM (VALUES {_values(CLUSTERS)}) v(cluster_id, node_id)",
    "draws": f"SELECT unnest(range((SELECT {DRAWS} FROM {{sample}})))::BIGINT AS draw",
}


#: Statistics that the last plans keep in memory: a few numbers a node and feature.
_KEPT: list[DataFrame] = []


def _kept(df: DataFrame) -> DataFrame:
    """``df`` persisted, so that a plan that uses it often reads the samples once; only the last few stay. Lost blocks are computed again."""
    while len(_KEPT) >= 4:
        _KEPT.pop(0).unpersist()
    _KEPT.append(df.persist())
    return _KEPT[-1]


class Relations:
    """Spark views of the basic relations over one matrix and forest, and of those derived from them."""

    def __init__(self, spark: SparkSession, samples: DataFrame, forest: Forest, cluster: DataFrame) -> None:
        self.spark = spark
        nodes = forest.nodes.select("node_id", "tree_id", "parent_id", "sister_id", "level", "lr", F.col("is_leaf").cast("int").alias("is_leaf"), F.get("features", F.lit(0)).alias("feature"))
        base = {"sample": samples, "cell": cells(samples), "node": nodes, "path": forest.path, "member": forest.members(samples), "cluster": cluster}
        n = F.count(F.lit(1))
        size = samples.agg(F.when(n < 10, n).when(n < 1000, 2 * F.floor(n / 3)).when(n < 5000, F.floor(n / 2)).otherwise(F.floor(n / 4)).alias("n"))
        base["draws"] = size.where("n > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("draw"))
        self.forest, self.samples, self.clusters = forest, samples, cluster
        tag = uuid.uuid4().hex[:8]
        self.names = {k: f"{k}_{tag}" for k in (*base, *DERIVED, "stat")}
        for k, df in base.items():
            df.createOrReplaceTempView(self.names[k])
        self.made: set[str] = set(base)

    def sql(self, body: str) -> DataFrame:
        if "stat" not in self.made and _needs(body, "stat"):
            self.made.add("stat")
            _kept(self.forest.node_sums(self.samples)).createOrReplaceTempView(self.names["stat"])
        if "bag" not in self.made and any(_needs(body, k) for k in ("bag", "inbag", "draw")):
            self.made.add("bag")
            keyed = self.sql("SELECT n.tree_id, n.parent_id, m.node_id, m.sample_id, {hex8('7|bag|', m.node_id, '|', m.sample_id)} AS h FROM {member} m JOIN {node} n ON n.node_id = m.node_id")
            row_numbers(keyed, ["node_id"], "h", "sample_id").withColumn("place", F.col("p") + 1).createOrReplaceTempView(self.names["bag"])
        for k, text in (DERIVED | FROM_SUMS).items():
            if k not in self.made and _needs(body, k):
                self.made.add(k)
                self.sql(text).createOrReplaceTempView(self.names[k])
        return self.spark.sql(dialect(body, "spark", self.names))


def _needs(body: str, name: str) -> bool:
    return f"{{{name}}}" in body


def dialect(body: str, engine: str, names: dict[str, str]) -> str:
    """Fill in relation names and the few functions that the engines spell differently."""
    import re

    def r(m):
        return f"(round({m[1]}, 6) + 0.0)"

    def hex8(m):
        h = f"substr(md5(concat({m[1]})), 1, 8)"
        return f"CAST(conv({h}, 16, 10) AS BIGINT)" if engine == "spark" else f"CAST(('0x' || {h}) AS BIGINT)"

    def pct(m):
        return f"percentile({m[1]}, {m[2]})" if engine == "spark" else f"quantile_cont({m[1]}, {m[2]})"

    def dim(m):
        return f"element_at(x, {int(m[1]) + 1})" if engine == "spark" else f"x[{int(m[1]) + 1}]"

    body = re.sub(r"\{hex8\((.*?)\)\}", hex8, body)
    body = re.sub(r"\{pct\((.*?); (.*?)\)\}", pct, body)
    body = re.sub(r"\{dim (\d+)\}", dim, body)
    body = re.sub(r"\{r: (.*?) :r\}", r, body, flags=re.S)
    return re.sub(r"\{(\w+)\}", lambda m: names[m[1]], body)


def duck(body: str) -> str:
    """The plan as one DuckDB statement over the driver's tables."""
    need: list[str] = []

    def visit(text: str) -> None:
        for k, t in (DUCK_BASE | DERIVED).items():
            if _needs(text, k) and k not in need:
                visit(t)
                need.append(k)

    visit(body)
    names = {k: f"r_{k}" for k in (*DUCK_BASE, *DERIVED)}
    ctes = ", ".join(f"r_{k} AS ({dialect((DUCK_BASE | DERIVED)[k], 'duckdb', names)})" for k in need)
    text = dialect(body, "duckdb", names)
    if not ctes:
        return text
    for start in ("WITH RECURSIVE ", "WITH "):
        if text.startswith(start):
            return f"WITH RECURSIVE {ctes}, {text[len(start):]}"
    return f"WITH {ctes} {text}"


def fixture_relations(spark: SparkSession, sf: str) -> Relations:
    cluster = spark.createDataFrame(CLUSTERS, "cluster_id int, node_id long")
    return Relations(spark, embeddings(spark, sf), fixture(spark), cluster)
