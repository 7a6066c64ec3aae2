"""A stated query set against all rows: the corpus stays where it is, bounded blocks of queries are broadcast."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .kernels import lean
from .scratch import written

#: Bytes of one broadcast block of queries at most, about; rows of the corpus that a task ranks at once.
QUERY_BYTES, RUN_ROWS = 32 << 20, 16384

_FOUND = "query_row long, query_id long, vec_id long, row long, score double"


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """``(row, vec_id, v)`` of each row that takes part, vector as doubles; ``row`` tells rows apart.

    Left out: null ids, null vectors, and vectors with a null or non-finite
    component; also, unless ``zero``, those without a component other than 0.
    Rows that repeat an id are rows of their own.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine.alias("fine"))
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def matrix(column, width: int) -> np.ndarray:
    """Vectors as rows of one matrix; missing components are 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy()
    out = np.zeros((len(sizes), width))
    at = np.concatenate(([0], np.cumsum(sizes)))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(at[-1]) - np.repeat(at[:-1], sizes)] = column.flatten().to_numpy()
    return out


def topmost(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids, then rows."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= -np.partition(-scores, k - 1)[k - 1])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((rows[at], ids[at], -scores[at]))][:k]


def _ranked(held, unit: Callable, k: int, run_rows: int):
    """A task's best for each query: runs of its rows are ranked one after the other, each against the best so far."""
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def run(batches):
        query_rows, query_ids, queries = held.value
        best = [none] * len(query_rows)

        def rank(tables):
            table = pa.Table.from_batches(tables)
            x = matrix(table["v"], queries.shape[1])
            ids, rows = table["vec_id"].to_numpy(), table["row"].to_numpy()
            least = np.array([b[2][-1] if len(b[2]) == k else -np.inf for b in best])
            for i, at, scores in unit(rows, x, query_rows, queries, least):
                old = best[i]
                a, b, c = np.concatenate((old[0], ids[at])), np.concatenate((old[1], rows[at])), np.concatenate((old[2], scores))
                top = topmost(a, b, c, k)
                best[i] = a[top], b[top], c[top]

        waiting, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, run_rows):
                part = batch.slice(lo, run_rows)
                if n + part.num_rows > run_rows:
                    rank(waiting)
                    waiting, n = [], 0
                waiting.append(part)
                n += part.num_rows
        if n:
            rank(waiting)
        for lo in range(0, len(best), 4096):
            some = best[lo : lo + 4096]
            size = [len(b[0]) for b in some]
            if sum(size):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_rows[lo : lo + 4096], size)), pa.array(np.repeat(query_ids[lo : lo + 4096], size)), *(pa.array(np.concatenate([b[j] for b in some])) for j in range(3))], schema=schema)

    return run


def _asked(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = rows.select("row", "vec_id", "v").toArrow()
    return got["row"].to_numpy(), got["vec_id"].to_numpy(), matrix(got["v"], width)


def blocked_topk(rows: DataFrame, is_query: Column, k: int, prepared: Callable, score: Column, run_rows: int = RUN_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows of each query, all but the query's own row.

    ``prepared(rows, n)`` gives the ranking of a run of rows and, where that may
    find too few, an exact one for queries that are left with fewer than they
    could have. A ranking ``unit(rows, X, query_rows, Q, least)`` yields
    ``(query number, places, scores)``, higher scores being better; what scores
    under ``least`` may be left out. Queries are broadcast block by block, each
    of bounded size; the corpus is never dealt out, and a task sends its ``k``
    best of each query only. ``score`` makes the result's score of ``score``.
    """
    spark = rows.sparkSession
    rows = written(rows, "vectors")
    n, m, width = rows.select(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.max(F.size("v"))).first()
    width = max(1, width or 1)
    blocks = max(1, -(-m * (width + 2) * 8 // query_bytes))
    unit, exact = prepared(rows, n)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")

    def best(asked, unit, name):
        held = spark.sparkContext.broadcast(asked)
        found = rows.mapInArrow(lean(_ranked(held, unit, k, run_rows)), _FOUND)
        return written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name), held

    parts = []
    for b in range(blocks):
        asked = _asked(rows.where(is_query & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)), width)
        found, held = best(asked, unit, "found")
        if exact is not None and len(asked[0]):
            full = found.where(F.col("rank") == min(k, n - 1)).select("query_row").toArrow()["query_row"].to_numpy()
            short = ~np.isin(asked[0], full)
            if short.any() and n > 1:
                held.destroy()
                again, held = best(tuple(a[short] for a in asked), exact, "found")
                few = spark.createDataFrame([(int(x),) for x in asked[0][short]], "query_row long")
                found = found.join(F.broadcast(few), "query_row", "left_anti").unionByName(again)
        held.destroy()
        parts.append(found)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("query_id", "rank", "vec_id", score.alias("score"))


def own_places(rows: np.ndarray, query_rows: np.ndarray) -> np.ndarray:
    """Place of each query's own row among ``rows``, -1 where it isn't."""
    order = np.argsort(rows)
    at = np.minimum(np.searchsorted(rows[order], query_rows), max(0, len(rows) - 1))
    return np.where(rows[order[at]] == query_rows, order[at], -1)


