"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

A text is a few statistics of its bytes and words. Their standardised values,
projected by Gaussian directions under a cosine, approximate a Gaussian kernel
(Rahimi and Recht 2007). The normal equations are sums over documents, so each
partition gives one small matrix; ridge scores then go through an isotonic step
function fitted on the part of the sample that the ridge did not see.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import byte_values, chunks, lean, running, shingle_sets, spaces, span_hash, word_spans
from .sample import labelled, rows_where, with_text
from .scratch import written

#: Labelled documents of the fit at most about; random features; ridge; partitions that sum.
FIT_ROWS, FEATURES, RIDGE, SUMS = 20_000, 192, 1.0, 8
#: Of eight hash classes of the sample, those that only calibrate.
CALIBRATE = (1, 4, 6)
#: The statistics, in order.
NAMES = ("log_words", "word_length", "upper", "digit", "exclaim", "pipe", "symbol", "stop", "other_sign", "newline", "distinct", "distinct_pairs", "again", "mark_ends", "long_words", "no_letter")


def statistics(data, starts, ends) -> np.ndarray:
    """One row of ``NAMES`` for each text of a chunk; a text without words has zeros."""
    n_docs = len(starts)
    values, breaks = byte_values(False), spaces()
    first, last, doc = word_spans(data, starts, ends, breaks)
    out = np.zeros((n_docs, len(NAMES)))
    if not len(first):
        return out
    words = np.bincount(doc, minlength=n_docs).astype(float)
    some = np.maximum(words, 1)
    size = np.maximum((ends - starts).astype(float), 1)
    kind = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 !, 4 |, 5 # $ % & * etc., 6 . , ; : ?, 7 other ASCII signs, 8 newline
    kind[33:127] = 7
    kind[65:91], kind[97:123], kind[48:58] = 1, 0, 2
    kind[33], kind[124], kind[10] = 3, 4, 8
    kind[[35, 36, 37, 38, 42, 64, 94, 126]] = 5
    kind[[44, 46, 58, 59, 63]] = 6
    k = kind[data]
    edges = np.flatnonzero(k)
    of = np.searchsorted(ends, edges, side="right")
    table = np.bincount(of * 9 + k[edges], minlength=n_docs * 9)[: n_docs * 9].reshape(n_docs, 9)
    h = span_hash(running(data, values), first, last)
    _, distinct = shingle_sets(h, doc, n_docs, 1)
    _, pairs = shingle_sets(h, doc, n_docs, 2)
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    length = (last - first).astype(float)
    final = kind[data[last - 1]]
    letters = (data >= 128) | ((data | 32) >= 97) & ((data | 32) <= 122)
    total = np.concatenate(([0], np.cumsum(letters)))
    bare = (total[last] - total[first]) == 0

    def per_word(x):
        return np.bincount(doc, weights=x, minlength=n_docs) / some

    out[:, 0] = np.log1p(words)
    out[:, 1] = per_word(length)
    out[:, 2:10] = np.sqrt(table[:, 1:9] / size[:, None])
    out[:, 10] = distinct / some**0.8
    out[:, 11] = pairs / some
    out[:, 12] = np.bincount(doc[same], minlength=n_docs) / some
    out[:, 13] = per_word(final >= 3)
    out[:, 14] = per_word(length > 16)
    out[:, 15] = per_word(bare)
    out[words == 0] = 0
    return out


def _measure(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float64()))])
    for batch in batches:
        for data, starts, ends, lo, hi in chunks(batch.column(0)):
            s = statistics(data, starts, ends)
            at = np.arange(hi - lo + 1, dtype=np.int32) * s.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at), pa.array(s.ravel()))], schema=schema)


def features(stats: np.ndarray, mean, scale, directions, shifts) -> np.ndarray:
    x = np.clip((stats - mean) / scale, -6, 6)
    return np.column_stack((np.ones(len(x)), np.sqrt(2 / len(shifts)) * np.cos(x @ directions + shifts)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(NAMES))


def _normal(mean, scale, directions, shifts):
    def run(batches):
        d = len(shifts) + 1
        total = np.zeros((d, d + 1))
        for batch in batches:
            z = features(_matrix(batch.column(0)), mean, scale, directions, shifts)
            y = batch.column(1).to_numpy().astype(float)
            total += z.T @ np.column_stack((z, y))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, value) of a non-decreasing fit by pooling adjacent violators.

    Half a document of either label at both ends keeps the first and last pool
    from 0 and 1; it is there before pooling, so the order of pools holds.
    """
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    # sum of y, count, sum of x; equal scores are one pool from the start
    start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    first = np.stack((np.add.reduceat(y, start), np.diff(np.append(start, len(x))), np.add.reduceat(x, start)), 1).astype(float)
    prior = [[0.5, 1.0, float(x[0])], [0.5, 1.0, float(x[-1])]]
    pools: list[list[float]] = []
    for pool in [prior[0], *first.tolist(), prior[1]]:
        pools.append(pool)
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, t = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + t]
    p = np.array(pools)
    return p[:, 2] / p[:, 1], p[:, 0] / p[:, 1]


class QualityModel:
    """Fitted on labelled documents outside the held-out fold; see ``fit``."""

    def __init__(self, shape, weights, knots) -> None:
        self.shape, self.weights, self.knots = shape, weights, knots

    @classmethod
    def fit(cls, measured: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, seed: int = 5) -> QualityModel:
        """Learn from the ``measured`` statistics of at most about ``rows`` labelled documents.

        With no label all texts score 0.5; with labels of one kind only, near that kind.
        """
        spark = measured.sparkSession
        sample = labelled(labels, "quality", rows)
        part = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(8))
        fit = measured.join(F.broadcast(sample), F.col("doc_id") == F.col("sample_id")).select("stats", "label", part.isin(*CALIBRATE).alias("calibrate"))
        fit = written(fit.coalesce(SUMS), "quality-fit")
        moments = fit.select(*[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(len(NAMES))], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(len(NAMES))]).first()
        if moments[0] is None:
            return cls((np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros((len(NAMES), 1)), np.zeros(1)), np.zeros(2), (np.zeros(1), np.array([0.5])))
        m = np.array(moments, float)
        mean, scale = m[: len(NAMES)], np.maximum(m[len(NAMES) :], 1e-3)
        rng = np.random.default_rng(seed)
        shape = (mean, scale, rng.standard_normal((len(NAMES), FEATURES)) / np.sqrt(len(NAMES) / 2), rng.random(FEATURES) * 2 * np.pi)
        learn = fit.where(~F.col("calibrate")).select("stats", "label")
        sums = sum(np.frombuffer(r.sums).reshape(FEATURES + 1, FEATURES + 2) for r in learn.mapInArrow(lean(_normal(*shape)), "sums binary").collect())
        n = max(1.0, sums[0, 0])
        left = sums[:, :-1] + RIDGE * np.sqrt(n) / 10 * np.diag([1e-6] + [1.0] * FEATURES)
        weights = np.linalg.solve(left, sums[:, -1])
        model = cls(shape, weights, (np.zeros(1), np.array([0.5])))
        rest = fit.where("calibrate").select("stats", "label").toArrow()
        if not rest.num_rows:
            rest = fit.select("stats", "label").toArrow()
        raw = features(_matrix(rest["stats"].combine_chunks()), *shape) @ weights
        model.knots = isotonic(raw, rest["label"].to_numpy().astype(float))
        return model

    @classmethod
    def fit_documents(cls, docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> QualityModel:
        """``fit`` where only the labelled sample of ``docs`` is measured."""
        sample = labelled(labels, "quality", rows)
        return cls.fit(measured(docs.join(F.broadcast(sample), F.col("doc_id") == F.col("sample_id"), "left_semi")), labels, rows)

    def score(self, measured: DataFrame) -> DataFrame:
        """``(doc_id, score)`` of each row of ``measured``."""
        held = measured.sparkSession.sparkContext.broadcast((self.shape, self.weights, self.knots))

        def run(batches):
            shape, weights, (x, y) = held.value
            for batch in batches:
                if batch.num_rows:
                    raw = features(_matrix(batch.column(1)), *shape) @ weights
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.interp(raw, x, y))], names=["doc_id", "score"])

        return measured.mapInArrow(lean(run), "doc_id long, score double")

    def kept(self, docs: DataFrame, least: float) -> DataFrame:
        """The rows of ``docs``, all columns as they are, that score ``least`` or more.

        One pass over the texts, without a shuffle. For nulls and empty texts
        see ``measured``; rows are judged each on its own.
        """
        held = docs.sparkSession.sparkContext.broadcast((self.shape, self.weights, self.knots))

        def judge(data, starts, ends):
            shape, weights, (x, y) = held.value
            return np.interp(features(statistics(data, starts, ends), *shape) @ weights, x, y) >= least

        return rows_where(docs, judge)


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, stats)`` of each whole text, written once.

    Null and wordless texts have zeros throughout. Null and repeated doc_ids
    are kept; other columns are ignored; an empty table gives an empty one.
    """
    return written(with_text(docs).mapInArrow(lean(_measure), "doc_id long, stats array<double>"), "stats")
