"""Matrices, headers, labels, sparse triples and serialised trees: reading and writing."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.forest import Forest, Split, rows_of


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """``(number, line)`` of text files in order of file name and line, of the lines that ``keep`` (of ``value``) holds for.

    Lines are numbered within the blocks in which they are read; blocks follow
    each other by file and offset. Only the count of each block is shuffled.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    if keep is not None:
        lines = lines.where(keep)
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a block
    return lines.join(blocks.select("file", "block", "first", ahead.alias("ahead")), ["file", "block"]).select((F.col("ahead") + F.col("at") - F.col("first")).alias("number"), F.col("value").alias("line"))


def read_matrix(spark: SparkSession, path: str, fill: float | None = None, sep: str = r"\s+") -> DataFrame:
    """``(sample_id, x)`` from text, one row a line, in line order; blank lines don't count.

    A cell that is no finite number raises, or becomes ``fill``.
    """
    rows = numbered_lines(spark, path, F.trim("value") != "")
    x = F.transform(F.split(F.trim("line"), sep), lambda v: v.try_cast("double"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    if fill is None:
        x = F.when(F.exists(x, bad), F.raise_error(F.concat(F.lit("not a finite number in line "), F.col("number")))).otherwise(x)
    else:
        x = F.transform(x, lambda v: F.when(bad(v), F.lit(fill)).otherwise(v))
    return rows.select(F.col("number").alias("sample_id"), x.alias("x"))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """``(feature_id, name)``, one name a line; repeats get a numeric suffix; quotes are stripped."""
    return unique_names(numbered_lines(spark, path).select(F.col("number").alias("feature_id"), F.expr("trim(both '\"' from trim(line))").alias("raw")))


def unique_names(names: DataFrame) -> DataFrame:
    """``(feature_id, name)`` of ``(feature_id, raw)``: names that repeat get their number from the second on."""
    seen = F.row_number().over(Window.partitionBy("raw").orderBy("feature_id")) - 1
    return names.withColumn("n", seen).select("feature_id", F.when(F.col("n") == 0, F.col("raw")).otherwise(F.concat("raw", F.col("n").cast("string"))).alias("name"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(node_id, cluster_id)`` from one whole number a line, in node order; other lines leave their node without label."""
    rows = numbered_lines(spark, path).select(F.col("number").alias("node_id"), F.trim("line").try_cast("int").alias("cluster_id"))
    return rows.where("cluster_id is not null")


def read_triples(spark: SparkSession, path: str, sep: str = " ", least_sample: float = 0.0, least_feature: float = 0.0) -> DataFrame:
    """``(sample_id, feature_id, value)`` from 1-indexed (row, column, value) text, of samples and features whose sums reach the bounds."""
    raw = spark.read.csv(path, sep=sep, schema="r long, c long, value double", comment="%")
    out = raw.where(F.col("r").isNotNull() & F.col("value").isNotNull()).select((F.col("r") - 1).alias("sample_id"), (F.col("c") - 1).cast("int").alias("feature_id"), "value")
    for key, least in (("sample_id", least_sample), ("feature_id", least_feature)):
        if least > 0:
            out = out.join(out.groupBy(key).agg(F.sum("value").alias("total")).where(F.col("total") >= least).select(key), key, "left_semi")
    return out.select("sample_id", "feature_id", "value")


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, feature_id, value)`` of a Matrix Market coordinate file; its line of sizes is the first that is no comment."""
    lines = numbered_lines(spark, path, (F.trim("value") != "") & ~F.col("value").startswith("%"))
    at = F.split(F.trim("line"), r"\s+")
    return lines.where("number > 0").select((F.get(at, F.lit(0)).cast("long") - 1).alias("sample_id"), (F.get(at, F.lit(1)).cast("int") - 1).alias("feature_id"), F.coalesce(F.get(at, F.lit(2)).cast("double"), F.lit(1.0)).alias("value"))


def cells(samples: DataFrame) -> DataFrame:
    """``(sample_id, feature_id, value)`` of a wide matrix."""
    return samples.select("sample_id", F.posexplode("x").alias("feature_id", "value"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings table as a matrix of doubles."""
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("x"), "label")


# ---- sinks


def write_matrix(samples: DataFrame, path: str) -> None:
    """``x`` of each sample as a line of text, in order of ``sample_id`` over the part files."""
    parts = samples.rdd.getNumPartitions()
    lines = samples.select("sample_id", "x").repartitionByRange(parts, "sample_id").sortWithinPartitions("sample_id")
    lines.select(F.concat_ws("\t", F.transform("x", lambda v: v.cast("string")))).write.text(path)


def write_names(spark: SparkSession, names: list[str], path: str) -> None:
    spark.createDataFrame([(n,) for n in names], "value string").coalesce(1).write.text(path)


# ---- trees


def _filter(up: Split, right: bool) -> dict:
    return {"reduction": {"features": list(up.features), "scores": list(up.scores), "means": list(up.means)}, "split": up.split, "orientation": right}


def tree_to_json(tree: Split, samples: dict[int, list[int]] | None = None) -> str:
    """One tree as nested JSON: the node's own samples, the filter that leads to it, children.

    ``samples`` are by the node's number in the tree, children before their
    parent, the root last; without them lists are empty.
    """
    number = rows_of([tree])[1][0]

    def node(t, up, right):
        return {"samples": (samples or {}).get(number[id(t)], []), "filter": _filter(up, right), "children": [] if t.left is None else [node(t.left, t, False), node(t.right, t, True)]}

    return json.dumps(node(tree, Split(), False))


def tree_from_json(text: str) -> Split:
    """The inverse of ``tree_to_json``; a node's test is read from its first child's filter."""
    return _tree(json.loads(text))


def _tree(d: dict) -> Split:
    if not d["children"]:
        return Split()
    f = d["children"][0]["filter"]
    r = f["reduction"]
    return Split(tuple(r["features"]), tuple(r["scores"]), tuple(r["means"]), f["split"], _tree(d["children"][0]), _tree(d["children"][1]))


def write_trees(forest: Forest, samples: DataFrame, path: str) -> None:
    """One JSON text a tree as ``value`` of text files under ``path``, with ``tree_id`` as folder: ``tree_id=0`` and so on.

    A tree's text holds the ids of all its samples at every node, so this is
    for matrices whose ids one task can hold; a model's ``backup`` has no such
    bound.
    """
    trees = forest.trees
    base = [min(n.values()) for n in forest.numbers]
    member = forest.members(samples).join(forest.nodes.select("node_id", "tree_id"), "node_id")
    grouped = member.groupBy("tree_id", "node_id").agg(F.array_sort(F.collect_list("sample_id")).alias("ids"))
    rest = forest.nodes.select("tree_id", "node_id").withColumn("ids", F.array().cast("array<long>"))
    grouped = grouped.unionByName(rest)

    def text(table: pa.Table) -> pa.Table:
        t = table["tree_id"][0].as_py()
        own: dict[int, list[int]] = {}
        for node, ids in zip(table["node_id"].to_pylist(), table["ids"].to_pylist(), strict=True):
            own[node - base[t]] = ids or own.get(node - base[t], [])
        return pa.table({"tree_id": pa.array([t], pa.int32()), "value": pa.array([tree_to_json(trees[t], own)])})

    grouped.groupBy("tree_id").applyInArrow(text, "tree_id int, value string").write.partitionBy("tree_id").text(path)


def read_trees(spark: SparkSession, pattern: str) -> list[Split]:
    """Trees of all files that match, in order of the last number in their path. Sample lists are dropped on the executors."""
    rows = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("f"), "value")

    def lean(batches):
        def bare(d):
            d["samples"] = []
            for kid in d["children"]:
                bare(kid)
            return d

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(bare(json.loads(v))) for v in batch.column(1).to_pylist()], pa.string())], names=["f", "value"])

    def number(file: str) -> int:
        folder, name = file.rsplit("/", 2)[-2:]
        found = re.findall(r"tree_id=(\d+)", folder) or re.findall(r"\d+", name)
        return int(found[-1]) if found else 0

    got = rows.mapInArrow(lean, "f string, value string").collect()  # tests only, a few numbers a node
    return [tree_from_json(r.value) for r in sorted(got, key=lambda r: (number(r.f), r.f))]


def tree_samples(spark: SparkSession, pattern: str) -> DataFrame:
    """``(tree, node_id, sample_id)`` of the sample lists in tree files; nodes are numbered within their tree, the root last."""
    def run(batches):
        for batch in batches:
            for f, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                order = []

                def below(d):
                    for kid in d["children"]:
                        below(kid)
                    order.extend(d["children"])

                root = json.loads(v)
                below(root)
                order.append(root)
                for i, d in enumerate(order):
                    if d["samples"]:
                        n = len(d["samples"])
                        yield pa.RecordBatch.from_arrays([pa.array([f] * n), pa.array([i] * n, pa.int64()), pa.array(d["samples"], pa.int64())], names=["tree", "node_id", "sample_id"])

    return spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("f"), "value").mapInArrow(run, "tree string, node_id long, sample_id long")
