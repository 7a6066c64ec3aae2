"""Column functions: scores of a reduction, the logistic curve, normal chances, lines of text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def linear_score(x: Column, features: Column, scores: Column, means: Column) -> Column:
    """Sum of (x[f] - mean) * score over a reduction's features; 0 for an empty one."""
    terms = F.arrays_zip(features.alias("f"), scores.alias("s"), means.alias("m"))
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + (F.element_at(x, t["f"] + 1) - t["m"]) * t["s"])


def scaled_score(x: Column, features: Column, scores: Column, means: Column) -> Column:
    """The linear score over the sum of the raw values of its features; null where that sum is 0."""
    total = F.aggregate(features, F.lit(0.0), lambda a, f: a + F.element_at(x, f + 1))
    return F.try_divide(linear_score(x, features, scores, means), total)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def two_sided(z: Column) -> Column:
    """Chance of a normal number as far from 0 as ``z``, within 2e-7 (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def tsv(*columns: Column) -> Column:
    """The columns as one line with tabs between; nulls are empty."""
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
