"""Connected components of an edge table by contraction, level by level.

A task replaces the edges that it reads by a star for each of their components:
every node and the least node reachable within the task (union-find, no
shuffle). If all edges left are few enough for one task, that is the answer.
Else tasks take ``EDGES`` each; a node that occurs in several has a root in
each, and these roots are the edges of the next level, which has fewer nodes:
the roots only. A node's component is that of its least root. A node is sent
once by each task, whatever its degree, so the centre of a star is no hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import lean
from .scratch import counted, written

#: Edges that one task holds, about.
EDGES = 1 << 20


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges and the smallest node reachable, by hooking roots to smaller ones and pointer jumping."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    up = np.arange(len(nodes))
    while True:
        ru, rv = up[u], up[v]
        hi, lo = np.maximum(ru, rv), np.minimum(ru, rv)
        apart = hi != lo
        if not apart.any():
            return nodes, nodes[up]
        u, v = u[apart], v[apart]
        np.minimum.at(up, hi[apart], lo[apart])
        while not np.array_equal(jumped := up[up], up):
            up = jumped


def _stars(batches):
    """Nodes and roots of what the task reads, at most ``EDGES`` edges at a time: these are taken together by contracting again."""
    held, n = [], 0

    def contracted():
        return least_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n > 4 * EDGES:
                held[:] = [contracted()]
                n = len(held[0][0])
    if held:
        node, root = contracted()
        for lo in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(node[lo : lo + (1 << 16)]), pa.array(root[lo : lo + (1 << 16)])], names=["node", "root"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node reachable.

    Nulls are ignored; a loop makes a node. An empty edge table gives an empty
    result. Repeated edges count once.
    """
    schema = "node long, root long"
    start = edges.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long"))
    stars, n = counted(start.mapInArrow(lean(_stars), schema), name)
    if n <= EDGES:
        return stars.coalesce(1).mapInArrow(lean(_stars), schema)
    stars = written(stars.repartition(-(-n // EDGES), "root").mapInArrow(lean(_stars), schema), name)
    met = written(stars.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")), name)
    links = met.where(F.size("roots") > 1).select(F.explode("roots").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()
    above = written(components(links, name), name).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return met.select("node", "root").join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
