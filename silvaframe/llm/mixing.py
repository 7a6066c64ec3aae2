"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The texts of a source are dealt by hash into blocks. A source whose target is r
times its size gives each block floor(r) times, in an order that is permuted
anew each time, and the first blocks of one more order until its quota of words
is met. The quotas of draws of all sources are then split among the output
shards by a tree: each node halves its shards and draws the left half's share
of every source's quota from the multivariate hypergeometric law, so a shard is
a random part of the mix while every quota is met exactly. A shard takes
consecutive runs of each source's permuted draws, so draws are disjoint, and
orders what it has by a local hash. The mix is dealt out to its shards, one
after the other, each in its order; a large shard is several partitions.

The driver sees sums of sources and blocks only: one row a source and at most
``ALL_BLOCKS`` and two a source for its blocks, however many texts there are.
Texts are read once for their size.
"""

from __future__ import annotations

from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import written

#: Blocks of a source at most, of all sources about, and words of a block at least.
BLOCKS, ALL_BLOCKS, BLOCK_WORDS = 4096, 1 << 18, 16384
#: Shards at least and at most, words of a shard between these, bounds of shards over all sources.
SHARDS, MOST_SHARDS, SHARD_WORDS, BOUNDS = 16, 4096, 64_000_000, 1 << 22
#: Weights of the sources in code point order, null last, over and over.
WEIGHTS = (3, 1, 2)
#: Words of the mix in proportion to all words; copies of a text at most.
SHARE, MOST = 1.5, 2.0
#: Words of a partition of the mix, about.
PART_WORDS = 8_000_000


def words_in(text: Column) -> Column:
    """Maximal runs of characters other than 0x20 and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: dict, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Words that each source is to give; what a full source can't take is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, rest = {}, list(order), share * sum(sizes.values())
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
        rest = max(0.0, rest - sum(out[s] for s in full))
        open_ = [s for s in open_ if s not in full]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of each source for each shard; rows sum to equal shares, columns to the quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)
    rng = np.random.default_rng(seed)
    stack = [(0, shards, np.asarray(quotas, np.int64))]
    while stack:
        lo, hi, here = stack.pop()
        if hi - lo == 1:
            out[lo] = here
            continue
        mid = (lo + hi) // 2
        take = int(here.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(here, take, method="marginals") if take else np.zeros_like(here)
        stack += [(lo, mid, left), (mid, hi, here - left)]
    return out


def shards_for(words: int, sources: int) -> int:
    """Output shards of a mix of so many words: more for a larger mix, within bounds."""
    return max(SHARDS, min(MOST_SHARDS, words // SHARD_WORDS, BOUNDS // max(1, sources)))


def orders(blocks: int, epochs: int, rng: np.random.Generator) -> tuple[list[int], list[int]]:
    """(factors, shifts): in epoch e block b has place ``(b * factors[e] + shifts[e]) % blocks``, a permutation."""
    factors = []
    while len(factors) < epochs:
        x = int(rng.integers(1, blocks + 1))
        if gcd(x, blocks) == 1:
            factors.append(x)
    return factors, rng.integers(0, blocks, epochs).tolist()


def mix_plan(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, shards: int | None = None, seed: int = 11, whole: bool = False) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_draws``.

    ``mix_draws`` is an array of ``struct<epoch, shard, place, words>``, one for
    each time the mix takes the text; ``place`` orders the draws of a shard; ``words`` is the text's size, but for one text
    of each source, of which the mix takes the first words only so that the
    source meets its target to the word. With ``whole`` the mix takes that text
    whole or not at all, whichever is nearer to the target, so that every draw
    is a whole text. Texts without words are never drawn.

    Null text has size 0. Null source is a source of its own, last in order.
    Without ``shards`` their number follows the words of the mix.

    Rows that repeat each other are separate texts, numbered by their other
    columns: of them too at most one is drawn in part. Columns of ``docs`` whose
    names start with ``mix_`` are replaced. An empty table gives an empty plan.
    Reruns over the same rows give the same draws.
    """
    return _planned(docs, weights, share, most, shards, seed, whole)[0]


def _planned(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, shards: int | None = None, seed: int = 11, whole: bool = False) -> tuple[DataFrame, int, int]:
    """The plan, its shards and the words of the mix."""
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text"))
    keyed = docs.withColumns({"mix_key": key, "mix_size": words_in(F.col("text").cast("string")), "mix_source": F.col("source").cast("string")})
    small = written(keyed.select("mix_key", "mix_size", "mix_source"), "sizes")

    sizes = {r[0]: r[1] for r in small.groupBy("mix_source").agg(F.sum("mix_size")).collect()}
    target = targets(sizes, weights, share, most)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    rng = np.random.default_rng([seed, 1])
    most_blocks = max(1, min(BLOCKS, ALL_BLOCKS // max(1, len(order))))
    rows = []
    for i, s in enumerate(order):
        words = round(target[s])
        epochs = words // sizes[s] if sizes[s] else 0
        blocks = int(min(most_blocks, max(1, sizes[s] // BLOCK_WORDS)))
        rows.append((s, i, sizes[s], float(target[s]), blocks, epochs, words - epochs * sizes[s], *orders(blocks, epochs + 1, rng)))
    shards = shards or shards_for(sum(round(t) for t in target.values()), len(order))
    source = "s string, s_no int, s_size long, s_target double, s_blocks int, s_epochs long, s_rest long, s_factors array<long>, s_shifts array<long>"
    names = spark.createDataFrame(rows, source)
    blocked = small.join(F.broadcast(names), small.mix_source.eqNullSafe(names.s))
    dealt = {"block": F.pmod("mix_key", F.col("s_blocks").cast("long")).cast("int"), "sub": F.pmod(F.xxhash64("mix_key", F.lit(1)), F.lit(BLOCKS).cast("long")).cast("int")}
    blocked = blocked.withColumns(dealt)

    # the block in which the last epoch's quota ends, the part of that block, then the text
    wordy = blocked.where("mix_size > 0")
    last_order = {r[1]: (r[7][-1], r[8][-1], r[4]) for r in rows}

    def place(s, block):
        factor, shift, blocks = last_order[s]
        return (block * factor + shift) % blocks

    ends, full = _end(wordy.groupBy("s_no", "block").agg(F.sum("mix_size").alias("w")).collect(), {r[1]: r[6] for r in rows}, place)
    last = spark.createDataFrame([(s, b) for s, (b, _) in ends.items()], "s_no int, block int")
    inside = wordy.join(F.broadcast(last), ["s_no", "block"])
    parts, _ = _end(inside.groupBy("s_no", F.col("sub").alias("block")).agg(F.sum("mix_size").alias("w")).collect(), {s: left for s, (_, left) in ends.items()})
    part = spark.createDataFrame([(s, b, left) for s, (b, left) in parts.items()], "s_no int, sub int, part_rest long")
    keys = inside.join(F.broadcast(part), ["s_no", "sub"]).groupBy("s_no", "part_rest", "mix_key").agg(F.min("mix_size").alias("size"), F.count(F.lit(1)).alias("k"))
    ahead = F.coalesce(F.sum(F.col("size") * F.col("k")).over(Window.partitionBy("s_no").orderBy("mix_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # of the k rows with a key, ``e_copies`` are taken whole and the next in part
    left = F.greatest(F.lit(0).cast("long"), F.col("part_rest") - F.col("ahead"))
    edge = keys.withColumn("ahead", ahead).withColumn("left", left).withColumn("copies", F.least("k", F.floor(F.col("left") / F.col("size"))))
    words = F.when(F.col("copies") < F.col("k"), F.col("left") - F.col("copies") * F.col("size")).otherwise(0)
    edge = edge.withColumn("words", F.least(words, F.col("size")))
    if whole:
        edge = edge.withColumns({"copies": F.col("copies") + (2 * F.col("words") >= F.col("size")).cast("long"), "words": F.lit(0).cast("long")})
    edge = edge.where("copies > 0 or words > 0").select(F.col("mix_key").alias("e_key"), F.col("s_no").alias("e_no"), F.col("copies").alias("e_copies"), F.col("words").alias("e_words"), F.expr("k > 1 and copies < k").alias("e_apart"))
    edge = written(edge, "edge")

    draws = [int(r[5]) * r[4] + (full.get(r[1], 0) + (r[1] in ends) if r[6] else 0) for r in rows]
    by_shard = split_quotas(np.array(draws, np.int64), shards, seed) if sum(draws) else np.zeros((shards, len(draws)), np.int64)
    bounds = np.cumsum(by_shard, 0)
    table = spark.createDataFrame(
        [(*r, [int(x) for x in bounds[:, r[1]]], place(r[1], ends[r[1]][0]) if r[1] in ends else -1, parts[r[1]][0] if r[1] in parts else -1) for r in rows],
        f"{source}, d_bounds array<long>, d_place int, d_sub int",
    )
    out = keyed.join(F.broadcast(table), keyed.mix_source.eqNullSafe(table.s)).withColumns(dealt)
    out = out.join(edge, (F.col("mix_key") == F.col("e_key")) & (F.col("s_no") == F.col("e_no")), "left")
    if edge.where("e_apart").head(1):
        apart = F.coalesce("e_apart", F.lit(False))
        number = F.row_number().over(Window.partitionBy("s_no", "mix_key").orderBy(F.xxhash64(*docs.columns))) - 1
        out = out.where(~apart).withColumn("number", F.lit(0)).unionByName(out.where(apart).withColumn("number", number))
    else:
        out = out.withColumn("number", F.lit(0))
    at_edge = F.when(F.col("number") < F.col("e_copies"), F.col("mix_size")).when(F.col("number") == F.col("e_copies"), F.col("e_words"))

    def placed(epoch: Column) -> Column:
        epoch = epoch.cast("int")
        return F.pmod(F.col("block") * F.get("s_factors", epoch) + F.get("s_shifts", epoch), F.col("s_blocks").cast("long"))

    last_place = placed(F.col("s_epochs"))
    before = (last_place < F.col("d_place")) | ((last_place == F.col("d_place")) & (F.col("sub") < F.col("d_sub")))
    out = out.withColumn("more", F.when(before, F.col("mix_size")).otherwise(F.coalesce(at_edge, F.lit(0).cast("long"))))

    # the number of (epoch, block) in the source's permuted draws tells its shard
    def draw(epoch: Column, words: Column) -> Column:
        number = epoch * F.col("s_blocks") + placed(epoch)
        shard = F.size(F.filter("d_bounds", lambda b: b <= number))
        place = F.xxhash64("mix_key", epoch.cast("long"), F.lit(seed))
        return F.struct(epoch.cast("long").alias("epoch"), shard.cast("int").alias("shard"), place.alias("place"), words.cast("long").alias("words"))

    none = F.array().cast("array<struct<epoch:bigint,shard:int,place:bigint,words:bigint>>")

    every = F.when((F.col("s_epochs") > 0) & (F.col("mix_size") > 0), F.transform(F.sequence(F.lit(0).cast("long"), F.col("s_epochs") - 1), lambda e: draw(e, F.col("mix_size")))).otherwise(none)
    extra = F.when(F.col("more") > 0, F.array(draw(F.col("s_epochs"), F.col("more")))).otherwise(none)
    plan = out.select(*docs.columns, "mix_key", "mix_size", F.col("s_size").alias("mix_source_size"), F.col("s_target").alias("mix_target"), F.concat(every, extra).alias("mix_draws"))
    return plan, shards, sum(round(t) for t in target.values())


def _end(sums, rest: dict[int, int], place=lambda s, block: block) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
    """For each source the block in which its rest ends and the words wanted of it; the blocks before it, by ``place``."""
    held: dict[int, list[tuple[int, int, int]]] = {}
    for r in sums:
        held.setdefault(r.s_no, []).append((place(r.s_no, r.block), r.block, r.w))
    ends, full = {}, {}
    for s, blocks in held.items():
        left = rest.get(s, 0)
        if left <= 0:
            continue
        for at, b, w in sorted(blocks):
            if left <= w:
                ends[s], full[s] = (b, left), at
                break
            left -= w
    return ends, full


def mixed(docs: DataFrame, seed: int = 11, **options) -> DataFrame:
    """The mix itself: one row of ``docs`` for each draw, with ``mix_shard`` and ``mix_place``.

    Partitions hold the shards one after the other, each in the order of
    ``mix_place``, its local shuffle; a shard of over ``PART_WORDS`` words is
    several partitions, cut by place. A text of which only the first words are
    drawn is cut after them; with ``whole`` there is none. For the cases of nulls, empty texts and repeated
    rows see ``mix_plan``.
    """
    plan, shards, words = _planned(docs, seed=seed, **options)
    drawn = plan.select(*[c for c in plan.columns if c != "mix_draws"], F.explode("mix_draws").alias("draw"))
    ends = F.split("text", "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")  # each part ends with a word
    cut = F.array_join(F.slice(ends, F.lit(1), F.col("draw.words").cast("int")), "")
    text = F.when(F.col("draw.words") < F.col("mix_size"), cut).otherwise(F.col("text"))
    out = drawn.withColumns({"text": text, "mix_shard": F.col("draw.shard"), "mix_place": F.col("draw.place")}).drop("draw")
    parts = max(1, -(-words // (shards * PART_WORDS)))
    part = F.least(F.floor((F.col("mix_place") / F.lit(2.0**64) + 0.5) * parts), F.lit(parts - 1))
    return out.repartitionById(shards * parts, (F.col("mix_shard") * parts + part).cast("int")).sortWithinPartitions("mix_shard", "mix_place")
