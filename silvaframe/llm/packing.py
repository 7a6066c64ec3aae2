"""Best-fit packing: patterns fitted by non-negative least squares, residuals by best fit.

Only lengths matter for a packing, so the driver sees the histogram of piece
lengths (as many numbers as a sequence has tokens) and never a piece. Patterns
of two or three lengths that fill a sequence exactly are enumerated, their
repeat counts fitted to the histogram by non-negative least squares and rounded
down to what is there (Krell et al. 2021). What is left is packed by best fit,
longest first, on counts instead of pieces. Every length then has runs of
ranks, each with its pattern, place in it and first sequence; a piece finds its
place by its rank among pieces of its length, which is its number in its task
plus the counts of the tasks before. No task ever holds all pieces of a length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .kernels import chunks, lean
from .scratch import text_batches, written
from .tokens import _counts, worker_tokens

#: Tokens of a sequence; patterns of three lengths that the fit may use.
LENGTH, PATTERNS = 2048, 16384


def few_length_patterns(present: np.ndarray, length: int, most: int = PATTERNS) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to ``length``, from lengths that are present."""
    has = np.zeros(length + 1, bool)
    has[present] = True
    a = np.arange(1, length)
    two = a[has[a] & has[length - a] & (a >= length - a)]
    rows = [np.stack((two, length - two, np.zeros_like(two)), 1)]
    some = present[(present > 0) & (present < length)]
    x, y = np.meshgrid(some, some, indexing="ij")
    z = length - x - y
    ok = (x >= y) & (y >= z) & (z > 0)
    three = np.stack((x[ok], y[ok], z[ok]), 1)
    three = three[has[three[:, 2]]]
    if len(three) > most:
        three = three[np.linspace(0, len(three) - 1, most).astype(int)]
    return np.concatenate((*rows, three))


def fitted(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths nearest to the histogram.

    Accelerated projected gradient; each pattern has three entries, so a
    product is three gathers and its transpose three counts.
    """
    n = len(histogram)
    h = histogram.astype(float)
    h[0] = 0
    use = patterns > 0

    def times(x):
        return sum(np.bincount(patterns[:, j], weights=x * use[:, j], minlength=n) for j in range(3))

    def back(r):
        return sum(r[patterns[:, j]] * use[:, j] for j in range(3))

    step = 1.0
    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(times(v))
        step = np.linalg.norm(v)
        v /= step
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(times(y) - h) / (step * 1.05))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def pattern_plan(histogram: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of every pattern; together they use the histogram up exactly."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[length]:
        plan.append(((length,), int(left[length])))
        left[length] = 0
    patterns = few_length_patterns(np.flatnonzero(left), length)
    if len(patterns):
        count = fitted(patterns, left)
        for i in np.argsort(-count, kind="stable").tolist():
            if count[i] < 1:
                break
            lengths = tuple(int(x) for x in patterns[i] if x)
            repeats = min(int(count[i]), *(int(left[x]) // lengths.count(x) for x in lengths))
            if repeats > 0:
                plan.append((lengths, repeats))
                for x in lengths:
                    left[x] -= repeats
    return plan + best_fit(left, length)


def best_fit(left: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over counts; alike bins are kept together."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []

    def put(space, lengths, n):
        if n:
            if space not in bins:
                bins[space] = []
                insort(spaces, space)
            bins[space].append((lengths, n))

    for x in np.flatnonzero(left)[::-1].tolist():
        c = int(left[x])
        while c:
            at = bisect_left(spaces, x)
            if at == len(spaces):
                lengths, n, space = (), -(-c // (length // x)), length
            else:
                space = spaces[at]
                lengths, n = bins[space].pop()
                if not bins[space]:
                    del bins[space]
                    spaces.pop(at)
            k = space // x
            full = min(n, c // k)
            put(space - k * x, (*lengths, *(x,) * k), full)
            c, n = c - full * k, n - full
            if c and n and c < k:
                put(space - c * x, (*lengths, *(x,) * c), 1)
                c, n = 0, n - 1
            if lengths:
                put(space, lengths, n)
    return [x for some in bins.values() for x in some]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where ranks of a length go."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, repeats in plan:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + repeats
            offset += x
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


_PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, ids binary, part int, local long"


def _pieces(key: str, held, length: int, end: int, with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("local", pa.int64())])

    def run(batches):
        encode = worker_tokens(key, held).texts
        part = TaskContext.get().partitionId()
        seen, rows = np.zeros(length + 1, np.int64), part << 40
        for batch in batches:
            for data, starts, ends, lo, hi in chunks(batch.column(0), 1 << 19):
                ids, count = encode(data, starts, ends)
                flat = np.insert(ids, np.cumsum(count), np.uint32(end)).astype("<u4")
                count = count + 1
                k = -(-count // length)
                doc, piece = np.repeat(np.arange(hi - lo), k), _counts(k)
                size = np.minimum(length, count[doc] - piece * length)
                at = np.concatenate(([0], np.cumsum(size))) * 4
                raw = flat.tobytes()
                view = memoryview(raw)
                crc = [crc32(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                order = np.argsort(size, kind="stable")
                rank = np.empty(len(size), np.int64)
                per = np.bincount(size, minlength=length + 1)
                rank[order] = _counts(per[per > 0])
                local = seen[size] + rank
                seen += per
                # binary arrays take their bytes from one buffer, cut at the pieces' bounds
                binary = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw)]).cast(pa.binary()) if with_ids else pa.nulls(len(size), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(lo, hi - lo).take(pa.array(doc)), pa.array(rows + doc), pa.array(piece, pa.int32()), pa.array(piece * length), pa.array(size), pa.array(crc, pa.int64()), binary, pa.array(np.full(len(size), part, np.int32)), pa.array(local)],
                    schema=schema,
                )
                rows += hi - lo

    return run


def _place(held):
    def run(batches):
        table = held.value
        key = table[:, 0] << 40 | table[:, 1]
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            size, rank = cols["length"].to_numpy(), cols.pop("rank").to_numpy()
            at = np.searchsorted(key, size << 40 | rank, side="right") - 1
            cols["sequence_id"] = pa.array(table[at, 2] + rank - table[at, 1])
            cols["offset"] = pa.array(table[at, 3])
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = 0, with_ids: bool = True) -> DataFrame:
    """Every text's tokens, in sequences of at most ``length``: one row for each piece.

    Columns ``doc_id, row, piece, start, length, ids_crc32, sequence_id,
    offset`` and, ``with_ids``, ``ids`` (little-endian unsigned 32-bit). A text
    gives its ids by the tokenizer file, which is read on the driver and sent
    to the executors, and then ``end``; only a text longer than a sequence is
    cut, into full sequences and a rest. ``row`` tells rows of ``docs`` apart,
    also those with the same doc_id.

    Null text counts as empty and gives one piece of ``end`` alone. Null and
    repeated doc_ids are kept, each row's pieces on their own. Other columns are
    ignored. An empty table gives an empty result. Sequence numbers run from 0
    without gaps, and the pieces of a sequence lie end to end from offset 0.
    """
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    file = Path(tokenizer).read_text(encoding="utf-8")
    held = spark.sparkContext.broadcast(file)
    pieces = written(texts.mapInArrow(lean(_pieces(str(crc32(file.encode())), held, length, end, with_ids)), _PIECES), "pieces")
    held.destroy()
    counts = written(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(length + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r.length] = r.n
    table = spark.sparkContext.broadcast(slots(pattern_plan(histogram, length)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = counts.select(F.col("length").alias("of"), F.col("part").alias("in_part"), F.coalesce(before, F.lit(0)).alias("ahead"))
    carry = ["doc_id", "row", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = pieces.join(ahead, (F.col("length") == F.col("of")) & (F.col("part") == F.col("in_part"))).select(*carry, (F.col("local") + F.col("ahead")).alias("rank"))
    columns = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, " + ("ids binary, " if with_ids else "") + "sequence_id long, offset long"
    return ranked.mapInArrow(lean(_place(table)), columns)
