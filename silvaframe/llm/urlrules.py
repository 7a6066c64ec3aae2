"""URL filtering by rules given and by association rules mined from labels.

Native: DataFrame and SQL functions and Spark's own FP-growth only.

A URL is a set of tokens: scheme, host labels and their parts, path words with
digits folded, query keys. FP-growth mines token sets of labelled URLs together
with their label; rules "tokens imply block" are kept if their confidence and
support reach the bounds, if so many blocked URLs are not to be expected by
chance, and if no rule with fewer of the same tokens is as sure. To match, each
rule is filed under the one of its tokens that is rarest among labelled URLs: a
URL meets just the rules filed under one of its tokens and keeps those whose
tokens it all has. Rules given by hosts and paths win over mined ones.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import written

#: Bounds of mined rules: share of labelled URLs (and at least so many), confidence, lift over the label's share (or half the way to certainty, if that is less), standard deviations over what chance gives.
SUPPORT, LEAST_URLS, CONFIDENCE, LIFT, SURE = 0.002, 6, 0.6, 1.5, 4.0
BLOCK = "label=block"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL; empty for null or one without ``://``."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, "\\."), lambda x: x != "")
    words = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "[/._-]+"), lambda x: (x != "") & (x != "0"))
    keys = F.transform(F.filter(F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.split_part(x, F.lit("="), F.lit(1))))
    parts = F.flatten(F.array(
        F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
        F.transform(F.flatten(F.transform(F.filter(labels, lambda x: F.instr(x, "-") > 0), lambda x: F.filter(F.split(x, "-"), lambda y: y != ""))), lambda x: F.concat(F.lit("part="), x)),
        F.transform(words, lambda x: F.concat(F.lit("path="), x)),
        keys,
        F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
    ))
    return F.when(url.isNotNull() & (F.instr(url, "://") > 0), F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def mined_rules(labelled: DataFrame, support=SUPPORT, confidence=CONFIDENCE, lift=LIFT, sure=SURE) -> DataFrame:
    """``(tokens, filed, confidence, support)`` of rules that imply block, from ``labelled(url, block)``; ``filed`` is the rarest token.

    Null urls and labels are left out. Without labels, or with labels of one
    kind only, there are no rules. All labelled URLs that are given are used.
    """
    spark = labelled.sparkSession
    base = labelled.where(F.col("url").isNotNull() & F.col("block").isNotNull()).select(tokens_of(F.col("url")).alias("tokens"), "block")
    base = written(base.where(F.size("tokens") > 0), "labelled-urls")
    n, blocked = base.select(F.count(F.lit(1)), F.count(F.when(F.col("block") == 1, 1))).first()
    if not n or not blocked or blocked == n:
        return spark.createDataFrame([], "tokens array<string>, filed string, confidence double, support double")
    least, share = min(1.0, max(support, LEAST_URLS / n)), blocked / n
    lift = min(lift, (1 + 1 / share) / 2)
    # only tokens of enough blocked URLs can be in a rule; they are fewer than those of a URL over the least support
    counted = base.select(F.explode("tokens").alias("token"), "block").groupBy("token").agg(F.sum(F.col("block").cast("long")).alias("k"), F.count(F.lit(1)).alias("all"))
    counted = written(counted.where(F.col("k") >= least * n), "tokens")
    useful = counted.agg(F.collect_list("token").alias("useful"))
    baskets = base.crossJoin(F.broadcast(useful)).select(F.array_intersect("tokens", "useful").alias("items"), "block")
    baskets = baskets.select(F.when(F.col("block") == 1, F.array_append("items", F.lit(BLOCK))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(minSupport=least, minConfidence=confidence).fit(baskets)
    chance = (F.col("support") * n - F.col("urls") * share) / F.sqrt(F.col("urls") * share * (1 - share))
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK) & (F.col("lift") >= lift))
    rules = rules.withColumn("urls", F.col("support") * n / F.col("confidence")).where(chance >= sure)
    rules = written(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "rules")
    small = rules.select(F.col("tokens").alias("s"), F.col("confidence").alias("c"))
    # a rule falls to one with fewer of its tokens that is as sure; subsets are met by their first token
    wider = rules.select("tokens", "confidence", F.explode("tokens").alias("t")).join(small.withColumn("t", F.col("s")[0]), "t")
    beaten = wider.where((F.size("s") < F.size("tokens")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("s", "tokens")) == 0)).select("tokens").distinct()
    left = rules.join(beaten, "tokens", "left_anti")
    rarest = left.select("tokens", F.explode("tokens").alias("token")).join(counted, "token").groupBy("tokens").agg(F.min_by("token", F.struct("all", "token")).alias("filed"))
    return written(left.join(rarest, "tokens").select("tokens", "filed", "confidence", "support"), "pruned")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(key, confidence)``: for each row of ``urls(key, url)`` that a mined rule matches, the surest one."""
    filed = rules.select(F.col("filed").alias("token"), "tokens", "confidence")
    # tokens repeat among URLs, rules are few: the index is joined by token
    met = urls.select("key", tokens_of(F.col("url")).alias("has")).select("key", "has", F.explode("has").alias("token")).join(filed, "token")
    return met.where(F.size(F.array_except("tokens", "has")) == 0).groupBy("key").agg(F.max("confidence").alias("confidence"))


def listed(parts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``parts(key, host, path)`` with ``rule`` and ``listed``: the longest given rule that fits, if any.

    ``rules`` are (verdict, host, path); a rule fits its host and all
    subdomains if the path starts with the rule's. Written out as a chain of
    tests, longest first, for a list of rules is given by hand and short.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in reversed(order):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return parts.withColumns({"rule": rule, "listed": verdict})


def judged(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], **bounds) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every row of ``pages(page_id, url)``.

    The verdict is the longest given rule's that fits, else block if a mined
    rule matches, else allow. Null urls and urls without ``://`` have an empty
    host and path, no rule and allow. Null and repeated page_ids are kept, one
    row each. Other columns are ignored; an empty table gives an empty one.
    """
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    parts = urls.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64("url").alias("key"))
    mined = mined_rules(labelled, **bounds)
    hits = matched(parts.where(F.col("url").isNotNull()).select("key", "url").distinct(), mined).select(F.col("key").alias("hit"))
    out = listed(parts, rules).join(hits, F.col("key") == F.col("hit"), "left")
    method = F.when(F.col("hit").isNotNull() & F.col("url").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", method).alias("verdict"))
