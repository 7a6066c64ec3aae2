"""Order statistics of groups of any size: values are cut into ranges, so no group meets in one task.

Cuts are approximate quantiles of each group, from sketches that are combined
before the shuffle. Equal values fall into the same range. Counts by range
(groups x ranges rows) tell how much lies ahead of each; only rows of a range
are then sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import two_sided

#: Ranges of a group; accuracy of the sketch.
RANGES, ACCURACY = 32, 1000


def cut(df: DataFrame, keys: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``range_no``: how many of its group's cuts lie below a row's value."""
    shares = F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)])
    cuts = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, shares, F.lit(ACCURACY))).alias("cuts"))
    named = cuts.select(*[F.col(k).alias(f"cut_{k}") for k in keys], "cuts")
    same = _all([F.col(k).eqNullSafe(F.col(f"cut_{k}")) for k in keys])
    return df.join(named, same).withColumn("range_no", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts", *[f"cut_{k}" for k in keys])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _sizes(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """For each group and range: what lies ahead of it (``ahead_*``), in it (``own_*``), and in the group (``all_*``)."""
    own = df.groupBy(*keys, "range_no").agg(*[c.alias(f"own_{k}") for k, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as a group has ranges
    whole = Window.partitionBy(*keys)
    out = own
    for k in sums:
        out = out.withColumn(f"ahead_{k}", F.coalesce(F.sum(f"own_{k}").over(before), F.lit(0))).withColumn(f"all_{k}", F.sum(f"own_{k}").over(whole))
    return out


def row_numbers(df: DataFrame, keys: list[str], value: str, tie: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``p``, a row's place from 0 by value then ``tie`` in its group, and ``n``, the group's rows."""
    parts = cut(df, keys, value, ranges)
    sizes = _sizes(parts, keys, {"n": F.count(F.lit(1))}).select(*keys, "range_no", "ahead_n", F.col("all_n").alias("n"))
    local = F.row_number().over(Window.partitionBy(*keys, "range_no").orderBy(value, tie)) - 1
    return parts.withColumn("local_p", local).join(sizes, [*keys, "range_no"]).withColumn("p", (F.col("ahead_n") + F.col("local_p")).cast("long")).drop("local_p", "ahead_n", "range_no")


def medians(df: DataFrame, keys: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """``(*keys, median)``, exact: only the ranges that hold the middle rows are sorted."""
    parts = cut(df, keys, value, ranges)
    sizes = _sizes(parts, keys, {"n": F.count(F.lit(1))})
    lo, hi = F.floor((F.col("all_n") - 1) / 2), F.floor(F.col("all_n") / 2)
    end = F.col("ahead_n") + F.col("own_n")
    middle = sizes.where(((lo >= F.col("ahead_n")) & (lo < end)) | ((hi >= F.col("ahead_n")) & (hi < end))).select(*keys, "range_no", "ahead_n", lo.alias("lo"), hi.alias("hi"))
    place = F.col("ahead_n") + F.row_number().over(Window.partitionBy(*keys, "range_no").orderBy(value)) - 1
    near = parts.select(*keys, "range_no", value).join(middle, [*keys, "range_no"]).withColumn("place", place)
    return near.where((F.col("place") == F.col("lo")) | (F.col("place") == F.col("hi"))).groupBy(*keys).agg(F.avg(value).alias("median"))


def two_samples(df: DataFrame, keys: list[str], value: str, other: str, ranges: int = RANGES) -> DataFrame:
    """``(*keys, value, a, b, before_a, before_b, n_a, n_b)``: each distinct value with its rows of either sample, those below it, and all.

    ``other`` is 0 or 1. Rank sums and the distance of distributions are sums
    and maxima over these rows.
    """
    counted = df.groupBy(*keys, value).agg(F.sum(1 - F.col(other)).alias("a"), F.sum(other).alias("b"))
    parts = cut(counted, keys, value, ranges)
    sizes = _sizes(parts, keys, {"a": F.sum("a"), "b": F.sum("b")})
    before = Window.partitionBy(*keys, "range_no").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = {f"local_{k}": F.coalesce(F.sum(k).over(before), F.lit(0)) for k in ("a", "b")}
    out = parts.withColumns(local).join(sizes, [*keys, "range_no"])
    return out.select(*keys, value, "a", "b", *[(F.col(f"ahead_{k}") + F.col(f"local_{k}")).alias(f"before_{k}") for k in ("a", "b")], F.col("all_a").alias("n_a"), F.col("all_b").alias("n_b"))


def rank_sum(df: DataFrame, keys: list[str], value: str, other: str, ranges: int = RANGES) -> DataFrame:
    """``(*keys, rank_sum, u, z, p)`` of the first sample, ties at their mean rank; z with the tie correction, p on two sides."""
    at = two_samples(df, keys, value, other, ranges)
    t = F.col("a") + F.col("b")
    rank = F.col("before_a") + F.col("before_b") + (t + 1) / 2
    got = at.groupBy(*keys).agg(F.sum(F.col("a") * rank).alias("rank_sum"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum(t * t * t - t).alias("ties"))
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = a + b
    u = F.col("rank_sum") - a * (a + 1) / 2
    sd = F.sqrt(a * b / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(u - a * b / 2, sd)
    z = F.when(sd > 0, z)
    return got.select(*keys, "rank_sum", u.alias("u"), z.alias("z"), two_sided(z).alias("p"))


def kolmogorov_smirnov(df: DataFrame, keys: list[str], value: str, other: str, ranges: int = RANGES) -> DataFrame:
    """``(*keys, ks)``: the largest distance of the two samples' distribution functions; null if one is empty."""
    at = two_samples(df, keys, value, other, ranges)
    gap = F.abs(F.try_divide(F.col("before_a") + F.col("a"), F.col("n_a")) - F.try_divide(F.col("before_b") + F.col("b"), F.col("n_b")))
    return at.groupBy(*keys).agg(F.max(gap).alias("ks"))


def jackknife(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``(*keys, mean, variance)`` of the leave-one-out means of ``value``.

    The variance of these means times n - 1 is the values' variance over n - 1,
    so two sums are enough.
    """
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.try_divide(F.var_pop(value), F.count(value) - 1).alias("variance"))
