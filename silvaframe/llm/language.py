"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords (runs of 1 to 4 letter
bytes, hashed into buckets), mapped linearly to languages; both layers are
trained by stochastic gradient descent (Joulin et al. 2017). Once trained the
two layers fold into one table of logits, so a whole text costs one look-up for
each subword. A temperature fitted on texts that the training did not see
calibrates the score, and the score under which a text is rejected is the one
that rejects a small share of those it gets right.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import U, byte_values, chunks, non_letters
from .sample import about, held_out, with_text

#: Documents of the fit, at most about; buckets, embedding size, subword lengths.
FIT_ROWS, BUCKETS, SIZE, GRAMS = 3000, 1 << 14, 16, (1, 2, 3, 4)
#: Passes over the sample, step size, texts of one step, share rejected of what is right.
PASSES, STEP_SIZE, BATCH, REJECT = 12, 0.5, 16, 0.01


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(bucket, start) of the subwords of a chunk, one array pair for each length."""
    values, breaks = byte_values(), non_letters()
    inside = ~breaks[data]
    v = values[data]
    fence = np.ones(len(data) + 1, bool)  # a text begins here
    fence[:] = False
    fence[starts[starts < len(data)]] = True
    h, ok = np.zeros(len(data), U), np.ones(len(data), bool)
    for n in range(1, max(GRAMS) + 1):
        k = len(data) - n + 1
        if k <= 0:
            return
        h = h[:k] * U(0x9E3779B97F4A7C15) + v[n - 1 :]
        ok = ok[:k] & inside[n - 1 :]
        if n > 1:
            ok &= ~fence[n - 1 : n - 1 + k]
        if n in GRAMS:
            at = np.flatnonzero(ok)
            x = h[at] + U(n)
            x ^= x >> U(29)
            x *= U(0xBF58476D1CE4E5B9)
            yield (x >> U(50)).astype(np.int64) & (BUCKETS - 1), at


def _sparse(batches):
    schema = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("bucket", pa.binary()), ("count", pa.binary())])
    for batch in batches:
        for data, starts, ends, lo, hi in chunks(batch.column(0)):
            keys = [np.zeros(0, np.int64)]
            for bucket, at in subwords(data, starts, ends):
                keys.append(np.searchsorted(ends, at, side="right") * BUCKETS + bucket)
            key, count = np.unique(np.concatenate(keys), return_counts=True)
            cut = np.searchsorted(key, np.arange(hi - lo + 1) * BUCKETS)
            b, c = (key % BUCKETS).astype(np.uint16), count.astype(np.float32)
            pairs = [(b[i:j].tobytes(), c[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo).cast(pa.string()), batch.column(2).slice(lo, hi - lo), pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], schema=schema)


def train(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, seed: int = 3) -> np.ndarray:
    """Table of logits (bucket, class) from sparse texts, by SGD over both layers.

    The texts of a step are one array of (bucket, share) pairs: the forward
    pass sums runs of it, the backward pass takes one matrix product.
    """
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    out = np.zeros((SIZE, classes), np.float32)
    steps = PASSES * -(-len(texts) // BATCH)
    size = np.array([len(b) for b, _ in texts])
    first = np.cumsum(size) - size
    bucket = np.concatenate([b for b, _ in texts])
    share = np.concatenate([c / c.sum() for _, c in texts]).astype(np.float32)
    done = 0
    for _ in range(PASSES):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            rate = STEP_SIZE * (1 - done / steps)
            done += 1
            n = size[some]
            begin = np.cumsum(n) - n
            at = np.repeat(first[some] - begin, n) + np.arange(n.sum())
            b, w, of = bucket[at], share[at, None], np.repeat(np.arange(len(some)), n)
            mean = np.add.reduceat(w * embed[b], begin)
            z = mean @ out
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            back = p @ out.T
            out -= rate * mean.T @ p
            unique, where = np.unique(b, return_inverse=True)
            order_ = np.argsort(where, kind="stable")
            starts = np.searchsorted(where[order_], np.arange(len(unique)))
            embed[unique] -= rate * 4 * np.add.reduceat((w * back[of])[order_], starts)
    return embed @ out


def _logits(table: np.ndarray, text) -> np.ndarray:
    b, c = text
    return (c[:, None] * table[b]).sum(0) / c.sum()


class LanguageModel:
    """Languages, table of logits, temperature and least score; see ``fit``."""

    def __init__(self, langs: list[str], table: np.ndarray, heat: float, least: float) -> None:
        self.langs, self.table, self.heat, self.least = langs, table, heat, least

    @classmethod
    def fit(cls, docs: DataFrame, rows: int = FIT_ROWS) -> LanguageModel:
        """Learn from text and non-null lang of about ``rows`` documents outside the held-out fold.

        Texts without a letter are left out. With no usable document there is
        no language and every text is ``und``.
        """
        known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
        known = about(known, "doc_id", known.select("doc_id").count(), rows)
        part = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(5)).cast("int")
        got = known.select(F.col("text").cast("string"), F.col("lang").cast("string"), part.alias("part")).mapInArrow(_sparse, "lang string, part int, bucket binary, count binary").toArrow()
        texts = [(np.frombuffer(b.as_buffer(), np.uint16).astype(np.int64), np.frombuffer(c.as_buffer(), np.float32)) for b, c in zip(got["bucket"].combine_chunks(), got["count"].combine_chunks(), strict=True)]
        names, parts = got["lang"].to_pylist(), got["part"].to_numpy()
        use = [i for i in sorted(range(len(texts)), key=lambda i: (parts[i], names[i], len(texts[i][0]), texts[i][1].sum())) if len(texts[i][0])]
        langs = sorted({names[i] for i in use})
        if not langs:
            return cls([], np.zeros((BUCKETS, 0), np.float32), 1.0, 0.0)
        code = {x: i for i, x in enumerate(langs)}
        y = np.array([code[names[i]] for i in use])
        texts = [texts[i] for i in use]
        tune = np.array([parts[i] == 0 for i in use])
        if tune.all() or not tune.any():
            tune = np.arange(len(use)) % 5 == 0
        learn = np.flatnonzero(~tune) if (~tune).any() else np.arange(len(use))
        table = train([texts[i] for i in learn], y[learn], len(langs))
        z = np.array([_logits(table, texts[i]) for i in np.flatnonzero(tune)])
        truth = y[tune]

        def chances(heat):
            e = np.exp((z - z.max(1, keepdims=True)) * heat)
            return e / e.sum(1, keepdims=True)

        heats = np.geomspace(0.25, 8, 31)
        cost = [-np.log(np.maximum(chances(h)[np.arange(len(truth)), truth], 1e-6)).mean() + 0.002 * h for h in heats]
        heat = float(heats[int(np.argmin(cost))])
        p = chances(heat)
        right = p.argmax(1) == truth
        least = float(np.quantile(p.max(1)[right], REJECT)) if right.any() else 0.0
        return cls(langs, table, heat, least)

    def predict(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, lang_pred, score, rejected)`` of each row's whole text.

        Null texts and texts without a letter are ``und`` with score 0 and are
        rejected. A text whose letters all lie outside what was seen still gets
        a learned language, with the score the model gives it; ``rejected``
        tells that the score is under the calibrated least. Null and repeated
        doc_ids are kept. Other columns are ignored.
        """
        held = docs.sparkSession.sparkContext.broadcast((self.langs, self.table, self.heat, self.least))
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

        def run(batches):
            langs, table, heat, least = held.value
            for batch in batches:
                for data, starts, ends, lo, hi in chunks(batch.column(0)):
                    n = hi - lo
                    total, count = np.zeros((n, len(langs))), np.zeros(n)
                    for bucket, at in subwords(data, starts, ends):
                        doc = np.searchsorted(ends, at, side="right")
                        per = np.bincount(doc, minlength=n)
                        count += per
                        full = np.flatnonzero(per)
                        if len(full) and len(langs):
                            total[full] += np.add.reduceat(table[bucket], (np.cumsum(per) - per)[full], axis=0)
                    ascii_ = np.zeros(n, np.int64)
                    low = data | 32
                    at = np.flatnonzero((low >= 97) & (low <= 122))
                    ascii_ += np.bincount(np.searchsorted(ends, at, side="right"), minlength=n)
                    letters = ascii_ > 0
                    for i in np.flatnonzero(~letters).tolist():
                        letters[i] = any(c.isalpha() for c in bytes(data[starts[i] : ends[i]]).decode("utf-8", "replace"))
                    z = total / np.maximum(count, 1)[:, None]
                    if langs:
                        e = np.exp((z - z.max(1, keepdims=True)) * heat)
                        p = e / e.sum(1, keepdims=True)
                        best, score = p.argmax(1), np.where(letters, p.max(1), 0.0)
                        names = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                    else:
                        names, score = ["und"] * n, np.zeros(n)
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, n), pa.array(names, pa.string()), pa.array(score), pa.array((score < least) | ~letters)], schema=schema)

        return with_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
