"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once with offsets; the sorted
spans of its turns and the spans of its tokens are intersected by binary
search. A token's loss mask is the stretch of characters that it shares with
an assistant's text, so tokens that straddle a turn's bounds carry only their
part, and characters that several byte-level tokens share count once.

Template, for each turn::

    ### <role>:
    <text></turn>

Inside texts ``\\``, ``#`` and ``<`` become a backslash and a letter, as do ``:``
and line ends inside roles; so no control string can occur in a text, and the
rendering reads back exactly.

A conversation of more than ``TURNS`` turns or ``CHARS`` characters is rendered
in segments cut between turns. The tokenizer never merges across the line end
before ``###``, so the tokens are those of the whole; rows stream in order, and
no task holds a whole long conversation.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import lean

#: Turns and characters of one rendered segment, at most.
TURNS, CHARS = 256, 1_000_000

HEAD, MID, TAIL = "### ", ":\n", "</turn>\n"
#: Signs and the letters that stand for them after a backslash: in texts the first three, in roles all.
SIGNS = {"\\": "b", "#": "h", "<": "l", ":": "c", "\n": "n", "\r": "r"}
_DO_TEXT = str.maketrans({k: "\\" + v for k, v in list(SIGNS.items())[:3]})
_DO_ROLE = str.maketrans({k: "\\" + v for k, v in SIGNS.items()})
_UNDO = re.compile(r"\\([bhlcnr])")


def escape(text: str) -> str:
    return text.translate(_DO_TEXT)


def escape_role(role: str) -> str:
    return role.translate(_DO_ROLE)


def unescape(text: str) -> str:
    back = {v: k for k, v in SIGNS.items()}
    return _UNDO.sub(lambda m: back[m[1]], text) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The rendering, the (start, end) of each turn's text in it, and which texts bear loss."""
    parts, spans, at = [], np.zeros((len(turns), 2), np.int64), 0
    for i, (role, text) in enumerate(turns):
        head, body = HEAD + escape_role(role) + MID, escape(text)
        parts += [head, body, TAIL]
        spans[i] = at + len(head), at + len(head) + len(body)
        at = spans[i, 1] + len(TAIL)
    return "".join(parts), spans, np.array([r == "assistant" for r, _ in turns], bool)


def mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """(start, end) of what each token shares with the sorted ``spans``; start = end where nothing.

    A token that covers several spans is given the stretch from the first to
    the last, with what lies between; spans of a rendering are apart by a
    turn's marks, which no token of this tokenizer crosses whole.
    """
    out = np.zeros_like(offsets)
    if not len(spans) or not len(offsets):
        return out
    i = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")  # the first span that ends after the token begins
    j = np.searchsorted(spans[:, 0], offsets[:, 1], side="left") - 1  # the last that begins before it ends
    hit = (i <= j) & (offsets[:, 1] > offsets[:, 0])
    i, j = np.minimum(i, len(spans) - 1), np.maximum(j, 0)
    lo, hi = np.maximum(offsets[:, 0], spans[i, 0]), np.minimum(offsets[:, 1], spans[j, 1])
    hit &= hi > lo
    out[hit, 0], out[hit, 1] = lo[hit], hi[hit]
    return out


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendering."""
    out = []
    for turn in formatted.split(TAIL)[:-1]:
        role, text = turn[len(HEAD) :].split(MID, 1)
        out.append((unescape(role), unescape(text)))
    return out


def runs(masks: np.ndarray) -> np.ndarray:
    """The masks of tokens joined to (start, end) of unbroken stretches, each character once."""
    some = masks[masks[:, 1] > masks[:, 0]]
    if not len(some):
        return some
    end = np.maximum.accumulate(some[:, 1])
    new = np.concatenate(([True], some[1:, 0] > end[:-1]))
    return np.stack((some[new, 0], end[np.append(new[1:], True)]), 1)


def read_loss(formatted: str, masks: np.ndarray) -> str:
    """All text under the loss mask, unescaped."""
    return unescape("".join([formatted[lo:hi] for lo, hi in runs(masks).tolist()]))


_SEGMENT = "conv_id long, segment long, n_turns long, formatted string, ids array<int>, offsets array<int>, loss array<int>"


def _format(held, tokens: bool):
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("loss", pa.list_(pa.int32()))])

    def run(batches):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(held.value)
        tokenizer.encode_special_tokens = True
        ready: list[tuple] = []

        def flush():
            texts = [r[3][0] for r in ready]
            cols = [[], [], []]
            for (_, _, _, (text, spans, loss)), e in zip(ready, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                masks = mask(offsets, spans[loss])
                cols[0].append(e.ids if tokens else None)
                cols[1].append(offsets.ravel().astype(np.int32) if tokens else None)
                cols[2].append((masks if tokens else runs(masks)).ravel().astype(np.int32))
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in ready], pa.int64()), pa.array([r[1] for r in ready], pa.int64()), pa.array([r[2] for r in ready], pa.int64()), pa.array(texts, pa.string()), *(pa.array(c, pa.list_(pa.int32())) for c in cols)], schema=schema)
            ready.clear()
            return out

        now, segment, turns, size = None, 0, [], 0
        started = False

        def close():
            if turns:
                ready.append((now[0], now[1] * (1 << 32) + segment, len(turns), render(turns)))

        for batch in batches:
            for conv, block, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                key, role, text = (conv, block), role or "", text or ""
                if started and (key != now or len(turns) >= TURNS or size > CHARS):
                    close()
                    segment = segment + 1 if key == now else 0
                    turns, size = [], 0
                    if sum(len(r[3][0]) for r in ready) > CHARS or len(ready) >= 256:
                        yield flush()
                now, started = key, True
                turns.append((role, text))
                size += len(role) + len(text)
        close()
        if ready:
            yield flush()

    return run


def formatted(conversations: DataFrame, tokenizer: str, tokens: bool = True) -> DataFrame:
    """Rendered segments of every conversation with token ids, offsets and loss masks.

    Columns ``conv_id, segment, n_turns, formatted, ids, offsets, loss``;
    offsets and loss hold a start and end for each token. Without ``tokens``,
    ids and offsets are null and loss holds a start and end for each unbroken
    stretch that the tokens' masks cover. Segments of a conversation follow
    each other by ``segment``; most have one. The tokenizer file is read on the
    driver and sent to the executors.

    Turns go by turn, then role, then text, nulls first. Null role or text is
    empty. Rows with a null conv_id are one conversation; repeated rows are
    kept. An empty table gives an empty result; other columns are ignored.
    """
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(1 << 20))).cast("long").alias("block"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), "turn")
    rows = rows.repartition(parts, "conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text").drop("turn")
    held = conversations.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    return rows.mapInArrow(lean(_format(held, tokens)), _SEGMENT)


_READ = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("n_turns", pa.int64()), ("turns", pa.binary()), ("loss_chars", pa.int64()), ("loss", pa.binary()), ("chars", pa.int64())])


def _read(batches):
    """What each segment says, read from its rendering: its turns and the text under its mask, packed for the way."""
    for batch in batches:
        rows = []
        for conv, segment, text, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            turns = read_turns(text)
            under = read_loss(text, loss.values.to_numpy().reshape(-1, 2))
            said = "".join([f"{role}\n{said}\n" for role, said in turns])
            rows.append((conv, segment, len(turns), zlib.compress(said.encode("utf-8", "surrogatepass"), 1), len(under), zlib.compress(under.encode("utf-8", "surrogatepass"), 1), len(text)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its ``formatted`` segments and their ``loss``.

    Columns ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars``. Segments are read where they are; only the hashing, which
    is sequential, brings a conversation's segments together, and runs over
    them as they stream by, so a long conversation is never held whole.
    """
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        now, state, out = None, None, []

        def rows():
            done = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return done

        def close():
            n, turns, chars, loss, size = state
            out.append((now[0], n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for conv, n, turns, loss_chars, loss, chars in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if now != (conv,):
                    if state:
                        close()
                        if len(out) >= 1000:
                            yield rows()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(zlib.decompress(turns))
                state[2] += loss_chars
                state[3].update(zlib.decompress(loss))
                state[4] += chars
        if state:
            close()
        if out:
            yield rows()

    read = segments.select("conv_id", "segment", "formatted", "loss").mapInArrow(lean(_read), "conv_id long, segment long, n_turns long, turns binary, loss_chars long, loss binary, chars long")
    rows = read.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "segment")
    return rows.drop("segment").mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
