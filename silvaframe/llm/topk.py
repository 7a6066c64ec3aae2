"""Exact top-k inner products by MaxScore.

A dimension is a term, its column in a run of rows the term's postings. A
term's bound for a query is the most that any row of the run gains from it.
Terms are taken by falling bound; those at the end whose bounds together stay
below the k-th best score known (of the rows that the task has seen) are
non-essential. The essential postings are traversed for the whole run, then the
others are probed a few at a time only for rows that may still compete (Turtle
and Flood 1995). Tasks' results are merged by score and id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .blocked import blocked_topk, own_places, usable

#: Non-essential terms that are probed before rows are dropped again.
PROBE = 4


def maxscore_unit(k: int):
    """The ranking of one run for ``blocked_topk``; exact while scores stay under 2**53."""

    def unit(rows, x, query_rows, queries, least):
        kind = np.float32 if x.shape[1] * np.abs(x).max(initial=0) * np.abs(queries).max(initial=0) < 2**24 else np.float64
        postings = np.ascontiguousarray(x.T, dtype=kind)
        high, low = np.maximum(postings.max(1), 0), np.minimum(postings.min(1), 0)
        places = own_places(rows, query_rows)
        for i, q in enumerate(queries.astype(kind)):
            own, floor = places[i], least[i]
            bound = np.maximum(q * high, q * low)
            order = np.argsort(-bound, kind="stable")
            rest = np.append(np.cumsum(bound[order][::-1].astype(np.float64))[::-1], 0.0)
            if floor == -np.inf:
                first = q @ postings[:, : 8 * k]
                if 0 <= own < len(first):
                    first[own] = -np.inf
                floor = -np.partition(-first, k - 1)[k - 1] if len(first) > k else -np.inf
            if rest[0] < floor:
                continue
            essential = int(np.searchsorted(-rest, -floor, side="right")) if np.isfinite(floor) else len(order)
            essential = min(max(essential, 1), len(order))
            score = q[order[:essential]] @ postings[order[:essential]]
            if own >= 0:
                score[own] = -np.inf
            live = np.flatnonzero(score + rest[essential] >= floor)
            score = score[live]
            for a in range(essential, len(order), PROBE):
                some = order[a : a + PROBE]
                score = score + q[some] @ postings[np.ix_(some, live)]
                keep = score + rest[min(a + PROBE, len(order))] >= floor
                live, score = live[keep], score[keep]
            fine = score > -np.inf
            yield i, live[fine], score[fine].astype(np.float64)

    return unit


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of each query's ``k`` highest integer inner products.

    Components become ``floor(scale * x)``, ``x`` as double. Candidates are all
    rows but the query's own; ties go to the smaller vec_id; a query with fewer
    candidates gets all. Null ids take no part, nor do vectors that are null or
    hold a null or non-finite component. Rows that repeat an id are rows of
    their own, as queries and as candidates. A shorter vector is filled up with
    zeros. An empty table gives an empty result; other columns are ignored.
    """
    rows = usable(vectors, True).withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double")))
    return blocked_topk(rows, is_query, k, lambda rows, n: (maxscore_unit(k), None), F.col("score").cast("long"))
