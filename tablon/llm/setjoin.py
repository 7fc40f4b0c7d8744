"""Set-similarity join with prefix, length and positional filters."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablon.session import cut_lineage

SMALL_CELLS = 1_000_000  # squares of the sizes of sets that are broadcast, added up: about 50 MB
SMALL_VOCABULARY = 100_000  # token counts are broadcast up to this many rows, which is checked


def grams(text: Column, n: int = 2) -> Column:
    """The distinct character n-grams of a text; a shorter text is its own gram, '' has none."""
    size = F.length(text)
    cut = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(size >= n, F.array_distinct(cut)).when(size > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def _ordered(sets: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """``id, size, pos, token``: the prefix of each set, its rarest tokens first. Two sets that reach
    the threshold share a token of their prefixes."""
    tokens = sets.select("id", F.explode("tokens").alias("token")).join(counts, "token")
    ordered = tokens.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("o"))
    size = F.size("o")
    length = size - F.ceil(F.lit(threshold) * size - F.lit(1e-9)).cast("int") + 1
    return ordered.select("id", size.alias("size"), F.posexplode(F.slice("o", F.lit(1), length)).alias("pos", "x")).select(
        "id", "size", "pos", F.col("x.token").alias("token")
    )


def _prefix_of(counts: dict[str, int], threshold: float):
    """Column function: the prefix of a set, its rarest tokens first, by counts that are sent along."""

    @F.pandas_udf("array<string>")
    def prefix(sets: pd.Series) -> pd.Series:
        def of(tokens) -> list[str]:
            order = sorted(tokens, key=lambda t: (counts.get(t, 0), t))
            return order[: len(order) - math.ceil(threshold * len(order) - 1e-9) + 1] if order else []

        return sets.map(of)

    return prefix


def _join_small(left: DataFrame, b: DataFrame, counts: dict[str, int], threshold: float) -> DataFrame:
    """``similarity_join`` with a right side that is sent to all executors: the left one isn't shuffled. Tokens are ordered by
    how rare they are on the right; what it lacks can't meet."""
    prefix = _prefix_of(counts, threshold)
    a = left.where("id is not null").select(F.col("id").alias("left_id"), F.col("tokens").alias("tx"), prefix("tokens").alias("fx"))
    x = a.select("*", F.size("tx").alias("sx"), F.posexplode("fx").alias("px", "token"))
    y = b.select(F.col("id").alias("right_id"), F.col("tokens").alias("ty"), F.size("tokens").alias("sy"), prefix("tokens").alias("fy"))
    y = F.broadcast(y.select("*", F.posexplode("fy").alias("py", "token")))  # checked by the caller
    met = x.join(y, "token").where(_possible(threshold))
    # A pair whose prefixes share several tokens counts at the first.
    first = F.get(F.array_intersect("fx", "fy"), F.lit(0)) == F.col("token")
    return met.where(first).select("left_id", "right_id", _jaccard().alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-9)


def _possible(threshold: float) -> Column:
    """Whether two sets (of ``sx`` and ``sy`` tokens) that share the tokens at ``px`` and ``py`` can reach the threshold."""
    needed = F.lit(threshold / (1 + threshold)) * (F.col("sx") + F.col("sy")) - F.lit(1e-9)
    most = F.least("px", "py") + 1 + F.least(F.col("sx") - F.col("px") - 1, F.col("sy") - F.col("py") - 1)
    near = (F.col("sy") >= F.lit(threshold) * F.col("sx") - 1e-9) & (F.col("sx") >= F.lit(threshold) * F.col("sy") - 1e-9)
    return near & (most >= needed)


def _jaccard() -> Column:
    common = F.size(F.array_intersect("tx", "ty"))
    return common / (F.size("tx") + F.size("ty") - common)


def similarity_join(left: DataFrame, right: DataFrame, threshold: float, small: int = SMALL_CELLS) -> DataFrame:
    """``left_id, right_id, jaccard`` of every pair of sets (``id, tokens`` without repeats) whose
    Jaccard similarity is ``threshold`` (over 0) or more.

    Tokens are ordered by how rare they are; only prefixes of the rarest meet,
    by an equi-join on the token, under the length and the positional filter. Then each pair is
    verified on its whole sets. The filters lose no pair; no common token brings rows together
    unless sets are made of common tokens only. Empty sets and null ids match nothing. A right side whose squared
    sizes, which are added up, are ``small`` at most, and of SMALL_VOCABULARY tokens, is broadcast; beyond, both sides are shuffled, with
    the same result. Ids of a side must be unique.
    """
    b = cut_lineage(right.where("id is not null and size(tokens) > 0").select("id", "tokens"))
    # A broadcast row is a prefix's token with its whole set.
    if (b.agg(F.sum(F.pow(F.size("tokens"), 2))).first()[0] or 0) <= small:
        rows = b.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).limit(SMALL_VOCABULARY + 1).collect()
        if len(rows) <= SMALL_VOCABULARY:
            return _join_small(left, b, {r[0]: r[1] for r in rows}, threshold)
    # Both are read three times, so what makes them is done once.
    a = cut_lineage(left.where("id is not null").select("id", "tokens"))
    counts = (
        a.select(F.explode("tokens").alias("token")).unionAll(b.select(F.explode("tokens").alias("token")))
        .groupBy("token").agg(F.count("*").alias("n"))
    )
    if counts.limit(SMALL_VOCABULARY + 1).count() <= SMALL_VOCABULARY:
        counts = F.broadcast(counts)
    x = _ordered(a, counts, threshold).toDF("left_id", "sx", "px", "token")
    y = _ordered(b, counts, threshold).toDF("right_id", "sy", "py", "token")
    pairs = x.join(y, "token").where(_possible(threshold)).select("left_id", "right_id").distinct()
    both = pairs.join(a.toDF("left_id", "tx"), "left_id").join(b.toDF("right_id", "ty"), "right_id")
    return both.select("left_id", "right_id", _jaccard().alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-9)
