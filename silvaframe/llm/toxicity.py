"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are words (runs of letters, case folded) and their first bytes, so that
inflected forms share evidence. A token's log-odds between toxic and other
labelled documents carry an informative Dirichlet prior from both (Monroe et
al. 2008), and count for as much as is sure at ``SURE`` standard deviations.
A text is the sequence of its words' scores, with a small negative score for
any other word; all its maximal scoring segments are found in one pass (Ruzzo
and Tompa 1999). A segment's significance follows the extreme-value law of
such maxima (Karlin and Altschul 1990), and a logistic curve over the evidence
of the significant segments gives the score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import U, byte_values, chunks, lean, mix, non_letters, running, shingle_sets, span_hash, word_spans
from .sample import labelled, rows_where, with_text
from .scratch import written

#: Labelled documents of the fit, at most about.
FIT_ROWS = 6000
#: Bytes of the word starts that are tokens of their own.
STARTS = (5, 4)
#: Score of a word that tells nothing; standard deviations taken off log-odds; least toxic documents of a token.
DRIFT, SURE, SEEN = -0.4, 2.0, 3
#: Weight of the prior, in documents, as a share of those labelled.
PRIOR = 0.2
#: Folds of the fit, for evidence on texts that a table hasn't seen.
FOLDS = 3
#: Significance that a segment needs.
LEVEL = 0.1


def _units(data, starts, ends, values, breaks):
    """Hashes of each word and of its first bytes (0 where it is shorter), and its text number."""
    first, last, doc = word_spans(data, starts, ends, breaks)
    sums = running(data, values)
    out = [span_hash(sums, first, last)]
    for k in STARTS:
        h = mix(span_hash(sums, first, np.minimum(first + k, last)) + U(k))
        out.append(np.where(last - first > k, h, U(0)))
    return out, doc


def _gather(batches):
    """One row for each labelled text: its least shingle, label and distinct tokens."""
    schema = pa.schema([("least", pa.int64()), ("label", pa.int32()), ("fold", pa.int32()), ("units", pa.binary())])
    values, breaks = byte_values(), non_letters()
    for batch in batches:
        for data, starts, ends, lo, hi in chunks(batch.column(0)):
            units, doc = _units(data, starts, ends, values, breaks)
            triples, n3 = shingle_sets(units[0], doc, hi - lo, 3)
            every = np.concatenate(units)
            single, n1 = shingle_sets(every[order := np.argsort(of := np.tile(doc, len(units)), kind="stable")], of[order], hi - lo, 1)
            at3, at1 = np.concatenate(([0], np.cumsum(n3))), np.concatenate(([0], np.cumsum(n1)))
            least = [int(triples[a]) - (1 << 63) if b > a else None for a, b in zip(at3[:-1], at3[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), *(batch.column(i).slice(lo, hi - lo) for i in (1, 2)), pa.array([single[a:b].tobytes() for a, b in zip(at1[:-1], at1[1:], strict=True)], pa.binary())], schema=schema)


def _count(batches):
    """Documents that have each token, by fold; ``batches(least, label, units, fold)``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        label, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3))
        sets = [np.frombuffer(x.as_buffer(), U) for x in batch.column(2)]
        size = [len(s) for s in sets]
        unit, back = np.unique(np.concatenate(sets), return_inverse=True)
        key, back = np.unique(back * FOLDS + np.repeat(fold, size), return_inverse=True)
        toxic = np.bincount(back, weights=np.repeat(label, size), minlength=len(key))
        total = np.bincount(back, minlength=len(key))
        yield pa.RecordBatch.from_arrays([pa.array(unit[key // FOLDS].view(np.int64)), pa.array((key % FOLDS).astype(np.int32)), pa.array(toxic.astype(np.int64)), pa.array((total - toxic).astype(np.int64))], names=["unit", "fold", "toxic", "other"])


def log_odds(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> np.ndarray:
    """What is sure of the log-odds of tokens found in so many of so many documents."""
    share = (toxic + other) / max(1.0, n_toxic + n_other)
    strength = PRIOR * (n_toxic + n_other)
    a = strength * share + 1e-3
    one = np.log((toxic + a) / (n_toxic + strength - toxic + 1e-3))
    two = np.log((other + a) / (n_other + strength - other + 1e-3))
    deviation = np.sqrt(1 / (toxic + a) + 1 / (other + a + 0.5))
    return one - two - SURE * deviation


def segments(at: np.ndarray, score: np.ndarray, drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments ``(score, first word, last word)``.

    ``at`` and ``score`` are the words with a positive score; every other word
    scores ``drift``. One pass; each segment is merged at most once.
    """
    stack: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, last
    total, end = 0.0, 0
    for i, s in zip(at.tolist(), score.tolist(), strict=True):
        total += drift * (i - end)
        left, total, end = total, total + s, i + 1
        now = (left, total, i, i)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= now[0]:
                j -= 1
            if j < 0 or stack[j][1] >= now[1]:
                break
            now = (stack[j][0], now[1], stack[j][2], now[3])
            del stack[j:]
        stack.append(now)
    return [(b - a, i, j) for a, b, i, j in stack]


def _words_scored(units, token, weight):
    best = np.zeros(len(units[0]))
    for u in units:
        at = np.minimum(np.searchsorted(token, u), max(0, len(token) - 1))
        if len(token):
            best = np.maximum(best, np.where(token[at] == u, weight[at], 0.0))
    return best


def _scan(model, values, breaks, data, starts, ends):
    """Evidence of each text's best segment, that of its significant ones together, and these."""
    token, weight, decay = model
    n_docs = len(starts)
    units, doc = _units(data, starts, ends, values, breaks)
    best = _words_scored(units, token, weight)
    hit = np.flatnonzero(best > 0)
    n = np.bincount(doc, minlength=n_docs)
    begin = np.cumsum(n) - n
    top, total, passages = np.zeros(n_docs), np.zeros(n_docs), [[] for _ in range(n_docs)]
    cut = np.searchsorted(doc[hit], np.arange(n_docs + 1))
    for d in np.flatnonzero(np.diff(cut)).tolist():
        h = hit[cut[d] : cut[d + 1]]
        for s, i, j in segments(h - begin[d], best[h]):
            sure = decay * s - math.log(n[d])  # minus log of the expected number by chance
            top[d] = max(top[d], sure)
            if sure > -math.log(LEVEL):
                total[d] += sure
                passages[d].append({"first": i, "last": j, "evidence": sure})
    return top, total, passages


def _evidence(model, n_carry: int, schema):
    def run(batches):
        values, breaks = byte_values(), non_letters()
        for batch in batches:
            for data, starts, ends, lo, hi in chunks(batch.column(0)):
                top, total, passages = _scan(model.value, values, breaks, data, starts, ends)
                extra = [pa.array(passages, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("evidence", pa.float64())])))] if "passages" in schema.names else []
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(1, 1 + n_carry)), pa.array(top), pa.array(total), *extra], schema=schema)

    return run


def _decay(share: float, score: float) -> float:
    """Positive root of E[exp(x s)] = 1 for words that score ``score`` with probability ``share``."""
    lo, hi = 1e-6, 50.0
    for _ in range(80):
        x = (lo + hi) / 2
        lo, hi = (x, hi) if share * math.exp(min(700, x * score)) + (1 - share) * math.exp(x * DRIFT) < 1 else (lo, x)
    return lo


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients, constant first, of a logistic regression by Newton steps."""
    z = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), grad)
    return w


class ToxicityModel:
    """Fitted on labelled documents outside the held-out fold; see ``fit``."""

    def __init__(self, token, weight, decay, curve) -> None:
        self.token, self.weight, self.decay, self.curve = token, weight, decay, curve

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> ToxicityModel:
        """Learn from at most about ``rows`` labelled texts; near copies count once (by their least shingle), texts without words too.

        Without any toxic or any other label the model scores all texts alike,
        by the share of toxic labels (0.1 if there is none).
        """
        spark = docs.sparkSession
        sample = labelled(labels, "toxic", rows)
        fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold")
        texts = written(with_text(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("sample_id")).select("text", "label", fold), "toxic-fit")
        once = written(texts.mapInArrow(lean(_gather), "least long, label int, fold int, units binary").groupBy("least", "label").agg(F.min("units").alias("units"), F.min("fold").alias("fold")), "toxic-units")
        n = np.zeros((FOLDS, 2))
        for r in once.groupBy("label", "fold").count().collect():
            n[r.fold, r.label] = r["count"]
        if not n.sum(0).all():
            share = n[:, 1].sum() / n.sum() if n.sum() else 0.1
            share = min(max(share, 0.01), 0.99)
            return cls(np.zeros(0, U), np.zeros(0), 1.0, np.array([math.log(share / (1 - share)), 0.0, 0.0]))
        counts = once.mapInArrow(lean(_count), "unit long, fold int, toxic long, other long").groupBy("unit")
        sums = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in ("toxic", "other") for f in range(FOLDS)]
        got = counts.agg(*sums).where(sum(F.col(f"toxic{f}") for f in range(FOLDS)) >= min(SEEN, max(1, int(n[:, 1].sum()) // 8))).toPandas()
        unit = got.unit.to_numpy().view(U)
        toxic, other = (got[[f"{c}{f}" for f in range(FOLDS)]].to_numpy(float) for c in ("toxic", "other"))
        model = cls(*cls._table(unit, toxic.sum(1), other.sum(1), *n.sum(0)[::-1]), np.array([-3.0, 0.5, 0.5]))
        # the curve is fitted to evidence from tables that haven't seen the text's fold
        tops, totals, labels_ = [], [], []
        for f in range(FOLDS):
            rest = [i for i in range(FOLDS) if i != f]
            part = cls(*cls._table(unit, toxic[:, rest].sum(1), other[:, rest].sum(1), *n[rest].sum(0)[::-1]), model.curve)
            held = part._evidence(texts.where(F.col("fold") == f), ["label"], {"label": pa.int32()}).toPandas()
            tops.append(held.top.to_numpy())
            totals.append(held.total.to_numpy())
            labels_.append(held.label.to_numpy(float))
        y = np.concatenate(labels_)
        if 0 < y.sum() < len(y):
            model.curve = logistic(model._shape(np.concatenate(tops), np.concatenate(totals)), y)
            model.curve[1:] = np.maximum(model.curve[1:], 0.0)
        return model

    @staticmethod
    def _table(unit, toxic, other, n_toxic, n_other):
        """(tokens sorted, their scores, decay of chance segments)."""
        lift = log_odds(toxic, other, n_toxic, n_other)
        keep = (lift > -2 * DRIFT) & (unit != 0) & (toxic > 1)
        order = np.argsort(unit[keep])
        token, weight = unit[keep][order], np.minimum(lift[keep][order], 6.0)
        share = min(0.2, (other[keep].sum() + 1) / (n_other * 400 + 1))  # hits by chance among words of other documents
        return token, weight, min(_decay(share, float(np.median(weight)) if len(weight) else 1.0), 6.0)

    @staticmethod
    def _shape(top, total):
        return np.column_stack((np.clip(top, 0, 8), np.log1p(total)))

    def _evidence(self, texts: DataFrame, carry: list[str], kinds: dict, passages: bool = False) -> DataFrame:
        held = texts.sparkSession.sparkContext.broadcast((self.token, self.weight, self.decay))
        found = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("evidence", pa.float64())]))
        schema = pa.schema([*kinds.items(), ("top", pa.float64()), ("total", pa.float64()), *([("passages", found)] if passages else [])])
        sql = ", ".join([*(f"{c} {'int' if k == pa.int32() else 'long'}" for c, k in kinds.items()), "top double, total double", *(["passages array<struct<first:bigint,last:bigint,evidence:double>>"] if passages else [])])
        return texts.select("text", *carry).mapInArrow(lean(_evidence(held, len(carry), schema)), sql)

    def score(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, score, passages)`` of each row; a passage has its first and last word and its evidence.

        Null, empty and wordless texts score as texts without any passage.
        Null and repeated doc_ids are kept. Other columns are ignored.
        """
        b, one, two = (float(x) for x in self.curve)
        out = self._evidence(with_text(docs), ["doc_id"], {"doc_id": pa.int64()}, True)
        line = F.lit(b) + F.lit(one) * F.least(F.greatest("top", F.lit(0.0)), F.lit(8.0)) + F.lit(two) * F.log1p("total")
        return out.select("doc_id", (1 / (1 + F.exp(-line))).alias("score"), "passages")

    def kept(self, docs: DataFrame, below: float) -> DataFrame:
        """The rows of ``docs``, all columns as they are, that score less than ``below``.

        One pass over the texts, without a shuffle. For nulls, empty texts and
        repeated ids see ``score``; rows are judged each on its own.
        """
        held = docs.sparkSession.sparkContext.broadcast((self.token, self.weight, self.decay))
        curve = self.curve

        def judge(data, starts, ends):
            top, total, _ = _scan(held.value, byte_values(), non_letters(), data, starts, ends)
            return 1 / (1 + np.exp(-(curve[0] + ToxicityModel._shape(top, total) @ curve[1:]))) < below

        return rows_where(docs, judge)
