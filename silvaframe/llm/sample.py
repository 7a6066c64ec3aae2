"""Bounded labelled samples and the fold rule for models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .kernels import chunks, lean
from .scratch import text_batches


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1. Null ids are not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Values of the hash by which samples are chosen.
SPACE = 1 << 62


def threshold(n: int, rows: int) -> int:
    """Hash values under this number belong to a sample of about ``rows`` of ``n``; never none of a table that has any."""
    return SPACE if n <= rows else max(1, rows * SPACE // n)


def about(table: DataFrame, key: str, n: int, rows: int) -> DataFrame:
    """About ``rows`` of the ``n`` rows of ``table``, chosen by a hash of ``key``, or all if fewer."""
    return table if n <= rows else table.where(F.pmod(F.xxhash64(key, F.lit(3)), F.lit(SPACE)) < F.lit(threshold(n, rows)))


def labelled(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``(sample_id, label)`` of about ``rows`` labelled documents outside the held-out fold, or all if fewer.

    Chosen by a hash of the id, so reruns agree. Labels of an id that occurs
    more than once are averaged; null ids and labels are left out.
    """
    fit = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    fit = fit.groupBy(F.col("doc_id").alias("sample_id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    return about(fit, "sample_id", fit.count(), rows)


def with_text(docs: DataFrame, *more: str) -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *more)


def rows_where(docs: DataFrame, judge: Callable) -> DataFrame:
    """The rows of ``docs`` whose text passes ``judge(bytes, starts, ends)``, which gives a boolean for each text of a chunk."""
    text_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for data, starts, ends, lo, hi in chunks(batch.column(at).cast(pa.string())):
                keep[lo:hi] = judge(data, starts, ends)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)


def rows_of(batch: pa.RecordBatch, lo: int, hi: int, columns: range) -> list[pa.Array]:
    return [batch.column(i).slice(lo, hi - lo) for i in columns]
