"""Summaries of clusters and consensus trees as JSON and HTML; the engine gives the tables, this module only renders."""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import DataFrame, functions as F

from . import factors
from .model import ForestModel


def cluster_summary(model: ForestModel, clusters: DataFrame, n: int = 10, pairs: list[int] | None = None) -> dict[int, dict]:
    """For each cluster its size, mean level and population, errors, changes, odds and most local correlations.

    Tables hold the ``n`` features of least and of greatest value; ``pairs``
    are the features among which correlations are looked for.
    """
    names = model.names
    out: dict[int, dict] = {}
    nodes = clusters.join(model.forest.nodes.select("node_id", "level"), "node_id").join(model.node_features().groupBy("node_id").agg(F.max("n").alias("n")), "node_id", "left")
    for r in nodes.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("nodes"), F.avg("level").alias("level"), F.avg("n").alias("population")).collect():
        out[r.cluster_id] = {"nodes": r.nodes, "level": r.level, "population": r.population}

    def put(table: DataFrame, key: str, value: str = "value"):
        for r in table.collect():
            out.get(r.cluster_id, {}).setdefault(key, []).append([names[r.feature_id], r[value]])

    def ends(table: DataFrame, key: str):
        last = table.groupBy("cluster_id").agg(F.max("place").alias("last"))
        put(table.join(last, "cluster_id").where((F.col("place") <= n) | (F.col("place") > F.col("last") - n)).orderBy("cluster_id", "place"), key)

    for against in ("parent", "sister", "root"):
        ends(factors.changes(model, clusters, against), f"change_{against}")
    by, whole = factors.strict_errors(model, clusters)
    put(by.orderBy("cluster_id", F.round("value", 9), "feature_id"), "error")
    for r in whole.collect():
        out.get(r.cluster_id, {})["fvu"] = r.fvu
    for r in factors.enrichment(model.forest, clusters).orderBy("cluster_id", "downstream").collect():
        out.get(r.cluster_id, {}).setdefault("enrichment", []).append([r.downstream, r.value])
    if pairs and len(pairs) > 1:
        for r in factors.most_local(model, clusters, pairs, n).orderBy("cluster_id", "place").collect():
            out.get(r.cluster_id, {}).setdefault("correlations", []).append([names[r.feature_a], names[r.feature_b], r.local, r.whole])
    for key in out.values():
        if "error" in key:
            key["error"] = key["error"][:n]
    return out


def summary_json(summary: dict[int, dict]) -> str:
    return json.dumps(summary, sort_keys=True)


def html_table(rows: list[list], head: list[str]) -> str:
    """A table with every cell escaped; numbers to four places."""
    def cell(x):
        return escape(f"{x:.4f}" if isinstance(x, float) else str(x))

    lines = ["<table>", "<tr>" + "".join(f"<th>{cell(h)}</th>" for h in head) + "</tr>"]
    lines += ["<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in rows]
    return "\n".join([*lines, "</table>"])


def cross_table(counts: dict[tuple, float], rows: list, columns: list) -> str:
    """Counts of two labelings against each other."""
    return html_table([[r, *[counts.get((r, c), 0) for c in columns]] for r in rows], ["", *map(str, columns)])


def _page(title: str, body: str) -> str:
    return f"<!DOCTYPE html>\n<html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body>\n<h1>{escape(title)}</h1>\n{body}\n</body></html>\n"


def cluster_page(cluster_id: int, about: dict, name: str | None = None) -> str:
    """One cluster's page of its ``cluster_summary``."""
    body = [html_table([[k, about.get(k)] for k in ("nodes", "level", "population", "fvu") if k in about], ["", "value"])]
    for key in ("change_parent", "change_sister", "change_root", "error", "enrichment"):
        if key in about:
            body += [f"<h2>{key.replace('_', ' ')}</h2>", html_table(about[key], ["name", "value"])]
    if "correlations" in about:
        body += ["<h2>correlations</h2>", html_table(about["correlations"], ["a", "b", "local", "whole"])]
    return _page(name or f"cluster {cluster_id}", "\n".join(body))


def tree_page(tree: list[tuple[int, int | None, int]], summary: dict[int, dict], names: dict[int, str] | None = None) -> str:
    """A consensus tree as nested lists and a drawing whose lines are as wide as clusters are populous."""
    names = names or {}
    width = {c: float(summary.get(c, {}).get("population") or 0.0) for c, _, _ in tree}
    at = {c: (x, d) for c, x, d, _ in factors.layout(tree, width)}
    most = max(width.values(), default=0.0) or 1.0
    lines = [f"<line x1='{40 + 80 * at[p][0]:.1f}' y1='{30 + 70 * at[p][1]}' x2='{40 + 80 * at[c][0]:.1f}' y2='{30 + 70 * at[c][1]}' stroke='black' stroke-width='{1 + 9 * width[c] / most:.1f}'/>" for c, p, _ in tree if p is not None]
    lines += [f"<text x='{40 + 80 * x:.1f}' y='{30 + 70 * d}'>{escape(names.get(c, str(c)))}</text>" for c, (x, d) in sorted(at.items())]
    kids: dict[int | None, list[int]] = {}
    for c, p, _ in tree:
        kids.setdefault(p, []).append(c)

    def nested(c):
        inner = "".join(nested(k) for k in sorted(kids.get(c, [])))
        return f"<li>{escape(names.get(c, str(c)))}{f'<ul>{inner}</ul>' if inner else ''}</li>"

    size = 80 * (1 + max((x for x, _ in at.values()), default=0)), 70 * (1 + max((d for _, d in at.values()), default=0))
    body = f"<svg width='{size[0]:.0f}' height='{size[1]}'>{''.join(lines)}</svg>\n<ul>{''.join(nested(c) for c in sorted(kids.get(None, [])))}</ul>"
    return _page("consensus tree", body)


def write_pages(path: str, spark, pages: dict[str, str]) -> None:
    """Each page as a text under ``path/name``, on whatever file system the path names."""
    for name, text in pages.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{name}")
