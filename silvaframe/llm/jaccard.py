"""Exact n-gram Jaccard self-join by token-group matrices.

1. Prefixes. Tokens have one total order: rare ones first. Two sets that reach
   the threshold share a token among the first ``n - ceil(t n) + 1`` of each.
   How often a token occurs is counted for a fixed part of the tokens, chosen
   by hash: those that occur once come first (they can't be shared, so they
   need not be sent back), then the others of that part by count, then the
   rest by hash. A text that has enough tokens of its own is done here. Counts
   over ``MANY`` are all alike: a task that meets a token so often sends its
   texts their answer at once, so no token gathers in one place.
2. Families. Texts that share a prefix token are tied to one of them (a star,
   never all pairs), and the components of these ties are families of similar
   texts. A passage that many texts share comes late in the order, so it ties
   only texts that have little else.
3. Token-group matrix. A family is cut into blocks of bounded size; a block is
   one unit of work. Within it similar texts form groups; the matrix
   holds each group's token union. For each text, postings of its tokens count
   the overlap with every group; an overlap under t % of the text's own size
   rules out every member. Only groups that may qualify and are not yet wholly
   in the text's class are opened: postings of that group alone are counted, and
   its members compared exactly.
4. Large families. A few texts of each block's largest class stand for it and
   are linked in ever larger bundles of blocks, so that a large group of near
   copies becomes one class at little cost. Blocks hold texts of like size:
   sizes that differ by more than the threshold can't link, so with classes of
   that width only the same and adjacent ones may. What is outside a family's
   largest class then meets every block of these classes, as the queries of a
   unit; so no pair that might link is left out, and a text is copied once for
   each block of such outsiders only.
5. Links found are kept as union-find forests per unit, joined by components.

Nothing is capped: memory is bounded by the block size, and equal sets are one
representative from the start. Words, shingles and whole sets are 64-bit hashes;
what is exact holds but for their collisions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import components
from .kernels import U, byte_values, chunks, lean, mix, shingle_sets, spaces, word_hashes
from .scratch import counted as written_counted, text_batches, written

#: Texts of one family in a block; texts that stand for a block, and blocks of a bundle; outsiders that meet a block at once.
BLOCK, STAND, BUNDLE, OUTSIDE = 192, 12, 16, 1024
#: Texts whose token union is one row of the matrix.
GROUP = 32
#: Tokens that a task gathers before it sends them out.
FLUSH = 2_000_000
#: Bits of the filter that says which texts belong to a family of two or more: for each of them, at least, at most.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 29
#: Texts of a token up to which it is counted exactly; sets that a task remembers.
MANY, REMEMBERED = 256, 1_000_000
#: Bytes of stored input of one shuffle partition, about.
PART_BYTES = 32 << 20
#: Keys with more than this share of the rows are looked up by broadcast; there are fewer than one over it.
HOT = 1 / 1000


def prefix_size(n, percent: int):
    """Tokens of a set of n that must hold one of any partner's."""
    return n - -(-percent * n // 100) + 1


def counted(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Which tokens are counted: twice the share that a prefix has, by hash."""
    return (tokens & U(7)) < U(min(8, -(-16 * (100 - percent) // 100)))


def set_hash(tokens: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each whole set; 0 for an empty one."""
    out = np.zeros(len(count), U)
    full = np.flatnonzero(count)
    if len(full):
        at = np.concatenate(([0], np.cumsum(count)))[full]
        out[full] = mix(np.add.reduceat(mix(tokens ^ U(0x5851F42D4C957F2D)), at) ^ (count[full].astype(U) << U(40))) | U(1)
    return out


def _sets(column, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    values, breaks = byte_values(), spaces()
    for data, starts, ends, lo, hi in chunks(column):
        words, doc = word_hashes(data, starts, ends, breaks, values)
        yield *shingle_sets(words, doc, hi - lo, n), lo, hi


_BLOBS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_BLOBS_SQL = "bucket int, kind int, a binary, b binary, c binary"
#: Kinds of blobs: counted tokens, sizes, prefix tokens, shared tokens, ties.
COUNTED, SIZES, PREFIX, SHARED, TIE = range(5)
#: Stands for a text where a token is known to have more than ``MANY``.
MARK = np.zeros(1, U)


def _dealt(kind: int, key: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows dealt to buckets by the high bits of ``key``, each bucket's as one blob a column."""
    place = ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    columns = [c[order] for c in columns]
    at = np.searchsorted(place[order], np.arange(buckets + 1))
    full = np.flatnonzero(at[1:] > at[:-1])
    for lo in range(0, len(full), 64):
        some = full[lo : lo + 64]
        blobs = [pa.array([c[at[i] : at[i + 1]].tobytes() for i in some], pa.binary()) for c in columns]
        blobs += [pa.nulls(len(some), pa.binary())] * (3 - len(columns))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), kind, np.int32)), *blobs], schema=_BLOBS)


def _tied(token: np.ndarray, node: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Texts with the same prefix token tied to the first of them here, which alone is sent on with the token."""
    token, node = _distinct(token, node)
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    at = np.flatnonzero(first)
    head = np.repeat(node[at], np.diff(np.append(at, len(token))))
    if not first.all():
        a, b = _distinct(node[~first], head[~first])
        yield from _dealt(TIE, a, buckets, a, b)
    yield from _dealt(PREFIX, token[at], buckets, token[at], node[at])


def _sign(n: int, percent: int, buckets: int):
    """Counted tokens of each text, its size and, if those are too few, what else its prefix has."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rest_held: list[tuple[np.ndarray, np.ndarray]] = []
        size_held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()

        def flush():
            tokens, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
            _, back, often = np.unique(tokens, return_inverse=True, return_counts=True)
            many = often[back] > MANY
            if many.any():
                known = np.unique(tokens[many])
                yield from _dealt(COUNTED, known, buckets, known, np.repeat(MARK, len(known)))
                yield from _dealt(SHARED, nodes[many], buckets, tokens[many], nodes[many], np.full(many.sum(), MANY + 1, U))
                tokens, nodes = tokens[~many], nodes[~many]
            yield from _dealt(COUNTED, tokens, buckets, tokens, nodes)
            yield from _tied(*(np.concatenate(x) for x in zip(*rest_held, strict=True)), buckets)
            h, size = (np.concatenate(x) for x in zip(*size_held, strict=True))
            yield from _dealt(SIZES, h, buckets, h, size)
            for x in (held, rest_held, size_held):
                x.clear()

        waiting = 0
        for batch in batches:
            for tokens, count, _, _ in _sets(batch.column(0), n):
                h = set_hash(tokens, count)
                new = np.zeros(len(h), bool)
                for i, x in enumerate(h.tolist()):
                    if x and x not in seen:
                        seen.add(x)
                        new[i] = True
                if len(seen) > REMEMBERED:
                    seen.clear()
                of = np.repeat(np.arange(len(count)), count)
                keep = new[of]
                tokens, of = tokens[keep], of[keep]
                some = counted(tokens, percent)
                held.append((tokens[some], h[of[some]]))
                n_some = np.bincount(of[some], minlength=len(count))
                lack = np.where(new, prefix_size(count, percent) - n_some, 0)
                rest, of = tokens[~some], of[~some]
                first = np.arange(len(of)) - np.searchsorted(of, of) < lack[of]  # tokens of a set are in order of hash
                rest_held.append((rest[first], h[of[first]]))
                size_held.append((h[new], (count[new].astype(U) << U(32)) | n_some[new].astype(U)))
                waiting += int(some.sum())
                if waiting > FLUSH:
                    yield from flush()
                    waiting = 0
        if held:
            yield from flush()

    return run


def _buckets(batches, kinds: tuple[int, ...], passed: list):
    """(bucket, columns of each kind) one bucket at a time; batches of other kinds are put into ``passed``."""
    now, parts = None, {}

    def joined():
        return {k: [np.concatenate([np.frombuffer(x.as_buffer(), U) for x in c]) for c in zip(*rows, strict=True)] for k, rows in parts.items()}

    for batch in batches:
        mine = np.isin(batch.column(1).to_numpy(), kinds)
        if not mine.all():
            passed.append(batch.filter(pa.array(~mine)))
            batch = batch.filter(pa.array(mine))
        for bucket, kind, *blobs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(i) for i in (2, 3, 4)), strict=True):
            if bucket != now:
                if parts:
                    yield joined()
                now, parts = bucket, {}
            parts.setdefault(kind, []).append([x for x in blobs if x.is_valid])
    if parts:
        yield joined()


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _share(buckets: int):
    """Counted tokens that more than one text has, sent to the texts with their count."""

    def run(batches):
        passed: list[pa.RecordBatch] = []
        for found in _buckets(batches, (COUNTED,), passed):
            token, node = _distinct(*found[COUNTED])
            _, first, back, often = np.unique(token, return_index=True, return_inverse=True, return_counts=True)
            often = np.minimum(np.where(node[first] == MARK, MANY + 1, often), MANY + 1)[back]
            more = (often > 1) & (node != MARK)
            yield from _dealt(SHARED, node[more], buckets, token[more], node[more], often[more].astype(U))
            yield from passed
            passed.clear()
        yield from passed

    return run


def _prefix(percent: int, buckets: int):
    """Shared tokens that fall into their text's prefix."""

    def run(batches):
        passed: list[pa.RecordBatch] = []
        for found in _buckets(batches, (SIZES, SHARED), passed):
            if SHARED in found:
                token, node, often = found[SHARED]
                order = np.lexsort((token, often, node))
                token, node = token[order], node[order]
                new = np.ones(len(node), bool)  # two tasks may have sent a text the same answer
                new[1:] = (node[1:] != node[:-1]) | (token[1:] != token[:-1])
                token, node = token[new], node[new]
                known, size = _distinct(*found[SIZES])
                at = np.searchsorted(known, node)
                rank = np.arange(len(node)) - np.searchsorted(node, node)
                shared = np.bincount(at, minlength=len(known))
                n, n_counted = (size >> U(32)).astype(np.int64), (size & U(0xFFFFFFFF)).astype(np.int64)
                keep = (n_counted - shared)[at] + rank < prefix_size(n, percent)[at]
                if keep.any():
                    yield from _tied(token[keep], node[keep], buckets)
            yield from passed
            passed.clear()
        yield from passed

    return run


def _tie(batches):
    """Each text tied to the first text with the same prefix token."""
    for found in _buckets(batches, (PREFIX, TIE), []):
        pairs = [found[TIE]] if TIE in found else []
        if PREFIX in found:
            token, node = _distinct(*found[PREFIX])
            first = np.ones(len(token), bool)
            first[1:] = token[1:] != token[:-1]
            at = np.flatnonzero(first)
            head = np.repeat(node[at], np.diff(np.append(at, len(token))))
            pairs.append([node[head != node], head[head != node]])
        a, b = _distinct(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _spot(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) >> U(20)).astype(np.int64) & (bits - 1)


def _bits(bits: int):
    def run(batches):
        out = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if batch.num_rows:
                s = _spot(batch.column(0).to_numpy().view(U), bits)
                np.bitwise_or.at(out, s >> 3, (1 << (s & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])

    return run


def _family_filter(family: DataFrame, members: int) -> np.ndarray:
    """A filter of the hashes in ``family(node)``, ``BITS_EACH`` bits for each; beyond ``MOST_BITS`` it lets more texts pass, which costs but changes nothing."""
    bits = LEAST_BITS
    while bits < min(members * BITS_EACH, MOST_BITS):
        bits *= 2
    out = np.zeros(bits // 8, np.uint8)
    for row in family.select("node").coalesce(8).mapInArrow(lean(_bits(bits)), "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out


def _measured(n: int, bits):
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("h", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        wanted = np.frombuffer(bits.value, np.uint8)
        space = len(wanted) * 8
        sent: set[int] = set()
        for batch in batches:
            ids, row = batch.column(1), batch.column(2)
            for tokens, count, lo, hi in _sets(batch.column(0), n):
                h = set_hash(tokens, count)
                s = _spot(h, space)
                hit = (wanted[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool) & (count > 0)
                at = np.concatenate(([0], np.cumsum(count)))
                sets = []
                for i, x in enumerate(h.tolist()):
                    once = hit[i] and x not in sent
                    if once:
                        sent.add(x)
                    sets.append(tokens[at[i] : at[i + 1]].tobytes() if once else None)
                if len(sent) > REMEMBERED:
                    sent.clear()
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), row.slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array(h.view(np.int64)), pa.array(sets, pa.binary())], schema=schema)

    return run


class _Classes:
    """Union-find over 0..n-1; the smaller number becomes the root."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def flat(self) -> np.ndarray:
        while not np.array_equal(x := self.up[self.up], self.up):
            self.up = x
        return self.up


def matrix_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Root of each set's class, and how many groups were opened and members compared.

    Sets marked ``left`` are the queries, those marked ``right`` the members of
    groups. Links between a query and a member decide the classes; sets with
    the same ``known`` label are one class from the start.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    classes = _Classes(n)
    if known is not None:
        _, first, label = np.unique(known, return_index=True, return_inverse=True)
        classes.up = first[label]
    members = np.flatnonzero(right)
    if not len(members) or not left.any():
        return classes.up, np.zeros(2, int)
    members = members[np.lexsort((members, size[members], [int(sets[i][0]) for i in members]))]
    place = np.repeat(np.arange(len(members)), size[members])
    vocabulary, token = np.unique(np.concatenate([sets[i] for i in members]), return_inverse=True)
    n_groups = -(-len(members) // GROUP)
    group = np.arange(len(members)) // GROUP
    cell, shared = np.unique(token * n_groups + place // GROUP, return_counts=True)  # the matrix, by token
    by_token, group_of_cell = cell // n_groups, cell % n_groups
    first_cell = np.searchsorted(by_token, np.arange(len(vocabulary) + 1))
    # postings of each group alone, by its tokens
    order = np.lexsort((token, place // GROUP))
    posting_token, posting = token[order], place[order]
    first_posting = np.searchsorted(posting // GROUP, np.arange(n_groups + 1))
    own = np.full(n, -1)
    own[members] = group
    opened = compared = 0

    for q in np.flatnonzero(left).tolist():
        mine = sets[q]
        at = np.searchsorted(vocabulary, mine)
        known = at[at < len(vocabulary)]
        known = known[vocabulary[known] == mine[at < len(vocabulary)]]
        need = -(-percent * size[q] // 100)
        if len(known) < need:
            continue
        a, b = first_cell[known], first_cell[known + 1]
        cells = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())
        bound = np.bincount(group_of_cell[cells], minlength=n_groups)
        if own[q] >= 0:  # in its own group a text meets the tokens of the others only
            bound[own[q]] = (shared[cells[group_of_cell[cells] == own[q]]] > 1).sum()
        may = bound >= need
        if not may.any():
            continue
        roots = classes.flat()
        for g in np.flatnonzero(may).tolist():
            lo, hi = g * GROUP, min((g + 1) * GROUP, len(members))
            other = np.flatnonzero(roots[members[lo:hi]] != roots[q]) + lo
            if not len(other):
                continue
            opened += 1
            compared += len(other)
            some = posting_token[first_posting[g] : first_posting[g + 1]]
            hit = known[np.minimum(np.searchsorted(known, some), len(known) - 1)] == some
            common = np.bincount(posting[first_posting[g] : first_posting[g + 1]][hit] - lo, minlength=hi - lo)[other - lo]
            linked = 100 * common >= percent * (size[q] + size[members[other]] - common)
            for j in members[other[linked]].tolist():
                classes.join(q, j)
    return classes.flat(), np.array([opened, compared])


_OPENED = "h long, root long, family long, cell int, tokens binary"


def _open(percent: int, stand: bool):
    """The classes of each unit; with ``stand`` the tokens of a few texts of its largest class go on with it, unless the unit is a whole family (``y`` is null)."""
    schema = pa.schema([("h", pa.int64()), ("root", pa.int64()), ("family", pa.int64()), ("cell", pa.int32()), ("tokens", pa.binary())])

    def unit(rows, family, cell):
        order = sorted(rows)
        sets, left, right, known = (list(x) for x in zip(*(rows[h] for h in order), strict=True))
        h = np.array(order)
        root, _ = matrix_links([np.frombuffer(t, U) for t in sets], np.array(left), np.array(right), percent, np.array(known))
        on: list[bytes | None] = [None] * len(h)
        if cell is not None and stand:
            most = np.bincount(root).argmax()
            of = np.flatnonzero(root == most)
            for i in of[np.unique(np.linspace(0, len(of) - 1, STAND).astype(int))].tolist():
                on[i] = sets[i]
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(h[root]), pa.array(np.full(len(h), family)), pa.array([cell] * len(h), pa.int32()), pa.array(on, pa.binary())], schema=schema)

    def run(batches):
        now, rows = None, {}
        for batch in batches:
            for family, x, y, h, tokens, left, right, known in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                key = (family, x, y)
                if key != now:
                    if rows:
                        yield unit(rows, now[0], now[2])
                    now, rows = key, {}
                old = rows.get(h, (tokens, False, False, known))
                rows[h] = (old[0], old[1] or left, old[2] or right, known)
        if rows:
            yield unit(rows, now[0], now[2])

    return run


def _opened(units: DataFrame, parts: int, percent: int, stand: bool, name: str) -> DataFrame:
    """Classes of ``units(family, x, y, h, tokens, left, right, known)``, written."""
    units = units.select("family", "x", "y", "h", "tokens", "left", "right", "known")
    return written(units.repartition(parts, "family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(lean(_open(percent, stand)), _OPENED), name)


def _row() -> Column:
    """Tells rows apart that differ in doc_id or text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _looked_up(rows: DataFrame, table: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """``rows`` left-joined with ``table``, whose ``weight`` is how many of ``total`` rows a key may have.

    Keys over the share ``HOT`` are fewer than one over it, so they are
    broadcast and never dealt out.
    """
    hot = F.col("weight") > HOT * total
    few, many = F.broadcast(table.where(hot).drop("weight")), table.where(~hot).drop("weight")
    rest = rows.join(few.select(key), key, "left_anti").join(many, key, "left")
    return rows.join(few, key).unionByName(rest)


def _numbered(sizes: DataFrame, rows: str, block: int, name: str) -> DataFrame:
    """``sizes(family, cls, ...)`` with ``name_blocks``, enough for ``rows``, and ``name_first``, their first number in the family."""
    blocks = F.ceil(F.col(rows) / block).cast("int")
    before = Window.partitionBy("family").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)  # a row for each class of sizes
    return sizes.withColumn(f"{name}_blocks", blocks).withColumn(f"{name}_first", F.coalesce(F.sum(f"{name}_blocks").over(before), F.lit(0)).cast("int"))


def _numbers(name: str) -> Column:
    """The numbers of a class's blocks, as an array."""
    first, blocks = F.col(f"{name}_first"), F.col(f"{name}_blocks")
    return F.when(blocks > 0, F.sequence(first, first + blocks - 1)).otherwise(F.array().cast("array<int>"))


def _partitions(docs: DataFrame) -> int:
    """Partitions of the session, or as many more as the stored size of ``docs`` asks for where Spark knows it."""
    stored = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(stored, 1 << 50) // PART_BYTES if stored < 1 << 50 else 0)


def _classes(texts: DataFrame, family: DataFrame, parts: int, percent: int) -> DataFrame:
    """``(node, root)`` of each text that is linked to another, from ``texts(h, tokens, n)`` and ``family(node, root)``."""
    large = written(family.groupBy("root").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") > BLOCK), "large")
    total = large.agg(F.sum("weight")).first()[0]
    yes, no = F.lit(True), F.lit(False)
    member = family.select(F.col("node").alias("h"), F.col("root").alias("family"))
    if not total:
        alone = texts.join(member, "h").withColumns({"x": F.lit(0), "y": F.lit(None).cast("int"), "left": yes, "right": yes, "known": F.col("h")})
        return _opened(alone, parts, percent, False, "local").where("h <> root").select(F.col("h").alias("node"), "root")

    # classes of sizes; a little wider than the threshold, so that rounding can't part what may link
    width = max(1e-3, math.log(100 / percent) * (1 + 1e-6))
    member = _looked_up(member, large.select(F.col("root").alias("family"), "weight", yes.alias("big")), "family", total)
    placed = texts.join(member, "h").withColumn("cls", F.when(F.col("big"), F.floor(F.log("n") / width).cast("int")))
    sizes = placed.where("big").groupBy("family", "cls").agg(F.count(F.lit(1)).alias("weight"))
    sizes = written(_numbered(sizes, "weight", BLOCK, "cell"), "sizes")
    cells = sizes.groupBy("family").agg(F.sum("cell_blocks").alias("cells")).agg(F.max("cells")).first()[0] or 0
    placed = _looked_up(placed, sizes, ["family", "cls"], total)
    cell = (F.col("cell_first") + F.pmod(F.xxhash64("h"), "cell_blocks")).cast("int")  # null in small families
    local = _opened(placed.withColumns({"x": F.coalesce(cell, F.lit(0)), "y": cell, "left": yes, "right": yes, "known": F.col("h")}), parts, percent, True, "local")
    apart = local.where("cell is null and h <> root").select(F.col("h").alias("node"), "root")
    inside = local.where("cell is not null")
    edges = inside.where("h <> root").select(F.col("h").alias("a"), F.col("root").alias("b"))
    stand = inside.where("tokens is not null")
    while cells > 1:
        cells = -(-cells // BUNDLE)
        bundle = F.floor(F.col("cell") / BUNDLE).cast("int")
        stand = _opened(stand.select("family", "h", "tokens", bundle.alias("x"), bundle.alias("y"), yes.alias("left"), yes.alias("right"), F.col("root").alias("known")), parts, percent, True, "bundles")
        edges = edges.unionByName(stand.where("h <> root").select(F.col("h").alias("a"), F.col("root").alias("b")))
        stand = stand.where("tokens is not null")
    merged = written(components(edges, "merged"), "merged")

    # what is outside the largest class of its family meets every block of like sizes
    of_cell = sizes.select("family", "cls", F.explode(_numbers("cell")).alias("cell"))
    placed = inside.select("h", "family", "cell").join(merged, F.col("h") == F.col("node"), "left").select("h", "family", "cell", F.coalesce("root", "h").alias("class"))
    placed = written(placed.join(of_cell, ["family", "cell"]), "placed")
    main = placed.groupBy("family", "class").agg(F.count(F.lit(1)).alias("k")).groupBy("family").agg(F.max(F.struct("k", "class")).alias("top"), F.sum("k").alias("weight"))
    main = written(main.where(F.col("weight") > F.col("top.k")).select("family", F.col("top.class").alias("main"), "weight"), "main")
    if main.isEmpty():
        return apart.unionByName(merged.where("node <> root"))
    placed = _looked_up(placed, main, "family", total).where("main is not null").withColumn("outside", F.col("class") != F.col("main"))
    others = placed.groupBy("family", "cls").agg(F.count(F.when(F.col("outside"), 1)).alias("others"), F.count(F.lit(1)).alias("weight"))
    others = written(_numbered(others, "others", OUTSIDE, "out").join(sizes.drop("weight"), ["family", "cls"]), "others")
    beside = others.select("family", F.col("cls").alias("other"), _numbers("out").alias("outs"), _numbers("cell").alias("cells"))
    near = others.join(beside, "family").where(F.abs(F.col("cls") - F.col("other")) <= 1).groupBy("family", "cls", "weight", "out_first", "out_blocks").agg(F.flatten(F.collect_list("outs")).alias("outs"), F.flatten(F.collect_list("cells")).alias("cells"))
    open_ = _looked_up(placed, near, ["family", "cls"], total).join(texts.groupBy("h").agg(F.first("tokens").alias("tokens")), "h")
    out = (F.col("out_first") + F.pmod(F.xxhash64("h", F.lit(2)), "out_blocks")).cast("int")
    every = open_.select("family", F.explode("outs").alias("x"), F.col("cell").alias("y"), "h", "tokens", no.alias("left"), yes.alias("right"), F.col("class").alias("known"))
    asked = open_.where("outside").select("family", out.alias("x"), F.explode("cells").alias("y"), "h", "tokens", yes.alias("left"), no.alias("right"), F.col("class").alias("known"))
    more = _opened(every.unionByName(asked), parts, percent, False, "outside")
    links = more.where("h <> root").select(F.col("h").alias("a"), F.col("root").alias("b"))
    ends = components(links.unionByName(merged.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))), "ends")
    return apart.unionByName(ends.where("node <> root"))


def _firsts(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``(doc_id, row, n_shingles, h, first)``: ``first`` has the id and row of the least id of each class with more than one row."""
    spark = docs.sparkSession
    text_batches(spark)
    parts = _partitions(docs)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    blobs = texts.mapInArrow(lean(_sign(n, percent, parts)), _BLOBS_SQL)
    for step in (_share(parts), _prefix(percent, parts)):
        blobs = blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(step), _BLOBS_SQL)
    ties = written(blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_tie), "a long, b long"), "ties")
    family, members = written_counted(components(ties, "families"), "family")
    held = spark.sparkContext.broadcast(_family_filter(family, members).tobytes())
    rows, total = written_counted(docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row")).mapInArrow(lean(_measured(n, held)), "doc_id long, row long, n_shingles long, h long, tokens binary"), "rows")
    held.destroy()

    texts = rows.where("tokens is not null").select("h", "tokens", F.col("n_shingles").alias("n"))
    classes = _classes(texts, family, parts, percent)

    # one row for each text, then for each class: copies are counted before anything is dealt by class
    rows = rows.select("doc_id", "row", "n_shingles", "h")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    texts = rows.where("n_shingles > 0").groupBy("h").agg(first, F.count(F.lit(1)).alias("k")).join(classes, F.col("h") == F.col("node"), "left")
    texts = written(texts.select("h", "first", "k", F.coalesce("root", "h").alias("class")), "texts")
    firsts = texts.groupBy("class").agg(F.min("first").alias("first"), F.sum("k").alias("rows"), F.count(F.lit(1)).alias("weight")).where("rows > 1")
    firsts = written(firsts.select("class", "first", "weight"), "firsts")
    by_text = _looked_up(texts.select("h", "k", "class"), firsts, "class", total)
    by_text = written(by_text.where("first is not null").select("h", F.col("k").alias("weight"), "first"), "by-text")
    alone = rows.where("n_shingles = 0").withColumn("first", F.lit(None).cast(by_text.schema["first"].dataType))
    return _looked_up(rows.where("n_shingles > 0"), by_text, "h", total).select(*alone.columns).unionByName(alone)


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs(doc_id, text, ...)``.

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, after A-Z
    are lower-cased. A text's set is its distinct ``n``-word shingles; a text
    with fewer words has its whole sequence as one. Two texts link if
    ``100 * |A & B| >= percent * |A | B|``. ``component_id`` is the smallest
    doc_id reachable by links.

    Null, empty and blank texts have 0 shingles and are a class of their own:
    their component is their doc_id. Rows with a null doc_id take part as
    texts; their component is the smallest doc_id of their class, null if it
    has none. Rows that repeat a doc_id are kept, one result row each; if they
    have different texts each row has its own class. Other columns are ignored.
    """
    rows = _firsts(docs, n, percent)
    return rows.select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those linked to another that stays.

    Of each class as ``jaccard_classes`` finds it the row with the smallest
    doc_id stays; null ids come last, ties go by a hash of id and text, and of
    rows with the same id and text one stays. Rows without words are all kept.
    """
    mark = next(x for i in range(len(docs.columns) + 1) if not any(c.startswith(x := f"own{i}_") for c in docs.columns))
    key, row, row_id = f"{mark}key", f"{mark}row", f"{mark}id"
    rows = written(_firsts(docs, n, percent).where("first is not null").select(F.col("row").alias(row), F.col("doc_id").alias(row_id), (F.col("row") == F.col("first.row")).alias("stays")), "decided")
    again = written(rows.where("stays").groupBy(row, row_id).count().where("count > 1").select(row, row_id), "again")
    keyed = docs.withColumn(key, _row())
    same = (F.col(key) == F.col(row)) & F.col("doc_id").cast("long").eqNullSafe(F.col(row_id))
    gone = rows.where("not stays").select(row, row_id).unionByName(again)
    # texts are dealt by row at every size: a broadcast of the ids would grow with the corpus
    kept = keyed.join(gone.hint("merge"), same, "left_anti")
    if not again.isEmpty():
        kept = kept.unionByName(keyed.join(again.hint("merge"), same, "left_semi").dropDuplicates([key, "doc_id"]))
    return kept.select(*docs.columns)
