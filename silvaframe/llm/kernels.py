"""NumPy kernels over the UTF-8 bytes of Arrow string columns.

Texts are never turned into Python strings here: words are found and hashed
by array operations over whole chunks, so cost is a few nanoseconds a byte.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (Steele, Lea, Flood 2014)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_values(fold_case: bool = True) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z if case is folded."""
    values = mix(np.arange(1, 257, dtype=U) * U(STEP))
    if fold_case:
        values[65:91] = values[97:123]
    return values


def spaces() -> np.ndarray:
    """True for the bytes 0x20 and 0x09 to 0x0D."""
    table = np.zeros(256, bool)
    table[[0x20, 9, 10, 11, 12, 13]] = True
    return table


def non_letters() -> np.ndarray:
    """True for ASCII bytes that are no letter; bytes of longer characters count as letters."""
    table = np.ones(256, bool)
    table[65:91] = table[97:123] = False
    table[128:] = False
    return table


def lean(run: Callable) -> Callable:
    """``run`` over a task's batches; afterwards the worker, which waits for its next task, gives free memory back."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for key, base in (("up", STEP), ("down", BACK)):
            out = np.full(max(n, 1 << 16), U(base))
            out[0] = U(1)
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"]


def chunks(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(bytes, starts, ends, first row, row after the last) of runs of whole texts.

    A run has at most ``most`` bytes unless one text alone has more. Null
    texts count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type) or pa.types.is_dictionary(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        base = at[lo]
        yield data[base : at[hi]], at[lo:hi] - base, at[lo + 1 : hi + 1] - base, lo, hi
        lo = hi


def word_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, breaks: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of bytes that don't break words.

    Where ``cuts`` is true a run ends and a new one begins.
    """
    inside = ~breaks[data]
    if not inside.any():
        return (np.zeros(0, np.int64),) * 3
    full = ends > starts
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[starts[full]] = False
    if cuts is not None:
        before &= ~cuts
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[ends[full] - 1] = False
    if cuts is not None:
        after[:-1] &= ~cuts[1:]
    first = np.flatnonzero(inside & ~before)
    last = np.flatnonzero(inside & ~after) + 1
    return first, last, np.searchsorted(ends, first, side="right")


def running(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span."""
    up, _ = _powers(max(1, len(data)))
    out = np.zeros(len(data) + 1, U)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, the same wherever its bytes stand."""
    _, down = _powers(max(1, len(sums)))
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(U))


def word_hashes(data, starts, ends, breaks, values) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word, in order."""
    first, last, doc = word_spans(data, starts, ends, breaks)
    return span_hash(running(data, values), first, last), doc


def shingle_sets(words: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``n``-word shingle hashes of each text, joined, and how many each has.

    A text with fewer words has its whole sequence as its one shingle; a text
    without words has none.
    """
    count = np.bincount(doc, minlength=n_docs)
    whole = max(0, len(words) - n + 1)
    h, of = words[:whole], doc[:whole]
    for j in range(1, n):
        h = mix(h * U(STEP) + words[j : whole + j])
    same = doc[: whole] == doc[n - 1 : whole + n - 1] if whole else np.zeros(0, bool)
    h, of = h[same], of[same]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        at = np.concatenate(([0], np.cumsum(count)))
        more = np.empty(len(short), U)
        for i, d in enumerate(short):
            x = count[d : d + 1].astype(U)
            for j in range(at[d], at[d + 1]):
                x = mix(x * U(BACK) ^ words[j : j + 1])
            more[i] = x[0]
        h, of = np.concatenate((h, more)), np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    else:
        h = h.copy()
    at = np.searchsorted(of, np.arange(n_docs + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[keep], of[keep]
    return h, np.bincount(of, minlength=n_docs)
