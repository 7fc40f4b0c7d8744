"""Rows of several sources that may state the same thing: a signal, nothing is removed."""

from __future__ import annotations

from difflib import SequenceMatcher
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablon.functions.text import block_token, dedup_text, token_containment, token_sort, values_match
from tablon.session import cut_lineage


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching runs of two texts, as Python's SequenceMatcher gives it; depends on the order."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def ratio_reaches(least: float):
    """Whether ``sequence_ratio`` is at least ``least``; the count of shared letters, which it can't exceed, decides first."""

    @F.pandas_udf(T.BooleanType())
    def reaches(a: pd.Series, b: pd.Series) -> pd.Series:
        m = (SequenceMatcher(None, x, y) for x, y in zip(a, b))
        return pd.Series([x.quick_ratio() >= least and x.ratio() >= least for x in m], dtype="bool")

    return reaches


def closure(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``row, least``: every row of ``pairs`` and the least row that it is linked to through any number of them.

    Each round takes the least label among neighbours, then that label's own label, so labels travel
    twice as far every round; rounds are written to the checkpoint folder until none changes.
    """
    ends = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = cut_lineage(ends.unionAll(ends.select("v", "u")).distinct())
    labels = cut_lineage(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least")))
    while True:
        near = edges.join(labels.toDF("v", "theirs"), "v").groupBy("u").agg(F.min("theirs").alias("near"))
        step = labels.join(near, "u").select("u", F.least("least", "near").alias("mid"), F.col("least").alias("old"))
        jump = step.join(labels.toDF("mid", "far"), "mid").select("u", F.least("mid", "far").alias("least"), "old")
        after = cut_lineage(jump)
        labels = after.select("u", "least")
        if after.where("least <> old").limit(1).isEmpty():
            return labels.toDF("row", "least")


def _normal(entity: str, title: str, region: str) -> list[Column]:
    """``r, k, e, t``: region, block, entity and title in the form that is compared."""
    name = dedup_text(F.col(entity))
    return [dedup_text(F.col(region)).alias("r"), block_token(name).alias("k"), token_sort(name).alias("e"), token_sort(dedup_text(F.col(title))).alias("t")]


def _linked_texts(texts: DataFrame, entity_least: float, title_least: float, containment_least: float) -> DataFrame:
    """``c1, c2, like`` of ``texts`` (``r, k, e, t``, number ``c``): those of one block, in this order, whose entities are alike and
    whose titles are (``like``) or share words."""
    bound = lambda x, y: 2 * F.least(F.length(x), F.length(y)) / (F.length(x) + F.length(y))
    spread = lambda x: cut_lineage(x.distinct().repartition(x.sparkSession.sparkContext.defaultParallelism))
    shares = token_containment(F.col("t1"), F.col("t2")) >= containment_least
    names = texts.select("r", "k", "e").distinct()
    near = names.withColumnRenamed("e", "e1").join(names.withColumnRenamed("e", "e2"), ["r", "k"]).where(bound("e1", "e2") >= entity_least)
    entities = cut_lineage(spread(near.select("e1", "e2")).where(ratio_reaches(entity_least)("e1", "e2")))
    one, two = (texts.select("r", "k", *[F.col(c).alias(f"{c}{n}") for c in ("e", "t", "c")]) for n in (1, 2))
    both = one.join(entities, "e1").join(two, ["r", "k", "e2"]).select("c1", "c2", "t1", "t2")
    titles = spread(both.select("t1", "t2")).select("t1", "t2", shares.alias("shares"), (bound("t1", "t2") >= title_least).alias("maybe"))
    decided = titles.where("maybe").select("t1", "t2", "shares", ratio_reaches(title_least)("t1", "t2").alias("like"))
    titles = cut_lineage(decided.unionAll(titles.where("not maybe and shares").select("t1", "t2", "shares", F.lit(False).alias("like"))))
    return both.join(titles.where("like or shares"), ["t1", "t2"]).select("c1", "c2", "like")


def similar_pairs(
    df: DataFrame, ident: str, entity: str, title: str, region: str, value: str | None,
    entity_least: float = 0.80, title_least: float = 0.82, containment_least: float = 0.60, tolerance: float = 0.05, python: bool = True,
) -> DataFrame:
    """``a, b`` (a < b): rows of one region and block whose entities are alike and whose titles are, or whose
    values match and titles share words. A block is a row's first longest word of the entity. Rows of blank
    entity or title are in no pair. ``python=False`` asks for equal entities and leaves sequence
    ratios out. Otherwise all rows of equal texts are one until the texts are decided, and texts too
    short to reach a ratio are left out before any Python runs.
    """
    number = (F.col(value) if value else F.lit(None)).cast("double").alias("v")
    rows = cut_lineage(df.select(F.col(ident).alias("id"), *_normal(entity, title, region), number).where("e <> '' and t <> ''"))
    match = values_match(F.col("v1"), F.col("v2"), tolerance)
    shares = token_containment(F.col("t1"), F.col("t2")) >= containment_least
    if not python:
        a, b = (rows.select(*[F.col(c).alias(f"{c}{n}") for c in ("id", "e", "t", "v")], "r", "k") for n in (1, 2))
        pairs = a.join(b, ["r", "k"]).where("id1 < id2 and e1 = e2")
        return pairs.where((F.col("t1") == F.col("t2")) | (match & shares)).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    # A ratio depends on the order of its texts, so both orders are decided, each once.
    texts = cut_lineage(rows.select("r", "k", "e", "t").distinct().withColumn("c", F.monotonically_increasing_id()))
    linked = _linked_texts(texts, entity_least, title_least, containment_least)
    known = rows.join(texts, ["r", "k", "e", "t"]).select("id", "v", "c")
    a, b = (known.toDF(f"id{n}", f"v{n}", f"c{n}") for n in (1, 2))
    pairs = a.join(linked, "c1").join(b, "c2").where(F.col("id1") < F.col("id2")).where(F.col("like") | match)
    return pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b"))


def dense_numbers(df: DataFrame, by: str, out: str) -> DataFrame:
    """``df`` with ``out``: 1, 2, ... in the order of ``by`` (unique). Rows are ordered by ranges, numbered within each and
    moved on by the counts of the ranges before, of which there are as many as partitions."""
    placed = cut_lineage(df.orderBy(by).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, before = [], 0
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "__p bigint, __before bigint"))  # a row for each partition
    return placed.join(offsets, part == F.col("__p")).withColumn(out, place + F.col("__before") + 1).drop("__id", "__p", "__before")


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """``id, dup_grupo, miembros``: groups of linked rows, numbered from 1 by their least row."""
    members = closure(pairs, "a", "b")
    sizes = members.groupBy("least").agg(F.count("*").alias("miembros"))
    numbered = dense_numbers(sizes, "least", "dup_grupo")
    return members.join(numbered, "least").select(F.col("row").alias("id"), "dup_grupo", "miembros")


def _sharing_texts(texts: DataFrame, containment_least: float) -> DataFrame:
    """``c1, c2`` of ``texts`` (``r, k, e, t``, number ``c``), each two once: those of equal entities whose titles differ and share words.
    Of the shorter title, all but as many words as it may lack are looked up among the words of the others."""
    words = F.array_distinct(F.split("t", " "))
    needed = F.greatest(F.lit(1), F.ceil(F.size("w") * containment_least - 1e-9).cast("int"))
    probe = F.slice("w", 1, F.greatest(F.lit(0), F.size("w") - needed + 1))
    sets = texts.select("r", "k", "e", "c", "t", words.alias("w"))
    short = sets.select("r", "k", "e", F.col("c").alias("a"), F.size("w").alias("m"), F.explode(probe).alias("w"))
    full = sets.select("r", "k", "e", F.col("c").alias("b"), F.size("w").alias("n"), F.explode("w").alias("w"))
    met = short.join(full, ["r", "k", "e", "w"]).where("a <> b and m <= n").select(F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2")).distinct()
    one, two = (texts.select(F.col("c").alias(f"c{n}"), F.col("t").alias(f"t{n}")) for n in (1, 2))
    return met.join(one, "c1").join(two, "c2").where(token_containment(F.col("t1"), F.col("t2")) >= containment_least).select("c1", "c2")


def _matching_values(links: DataFrame, values: DataFrame, tolerance: float) -> DataFrame:
    """``c1, c2`` of ``links`` (``c1, c2, free``) that have ``values`` (``id, c, v``) which match, the first's row before the second's; in
    any order where ``free``.

    Values of a text are reduced to ranges so narrow that all values of one match. Of values in other
    ranges the closest decide, and single values only where the order of the rows matters.
    """
    least_most = [F.min("id").alias("first"), F.max("id").alias("last")]
    values = values.where(F.col("v") > 0).where(~F.isnan("v")).withColumn("inf", F.col("v") == float("inf"))
    values = values.withColumn("z", F.when(~F.col("inf"), F.floor(F.log("v") / (-0.9 * log(1 - tolerance)))))
    singles = cut_lineage(values.groupBy("c", "inf", "z", "v").agg(*least_most))
    cells = cut_lineage(singles.groupBy("c", "inf", "z").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    side = lambda x, n: x.toDF(*[f"{c}{n}" for c in x.columns])
    order = F.col("first1") < F.col("last2")
    # What is infinite matches what isn't, and only that.
    ends = cells.groupBy("c", "inf").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    odd = links.join(side(ends, 1), "c1").join(side(ends, 2), "c2").where("inf1 <> inf2").where(F.col("free") | order).select("c1", "c2")
    finite = cells.where("not inf").drop("inf")
    near = links.join(side(finite, 1), "c1").withColumn("z2", F.explode(F.sequence(F.col("z1") - 2, F.col("z1") + 2))).join(side(finite, 2), ["c2", "z2"])
    up = F.col("z1") < F.col("z2")
    closest = values_match(F.when(up, F.col("hi1")).otherwise(F.col("lo1")), F.when(up, F.col("lo2")).otherwise(F.col("hi2")), tolerance)
    farthest = values_match(F.when(up, F.col("lo1")).otherwise(F.col("hi1")), F.when(up, F.col("hi2")).otherwise(F.col("lo2")), tolerance)
    same = F.col("z1") == F.col("z2")
    sure = (F.col("free") & (same | closest)) | (order & (same | farthest))
    met = cut_lineage(near.where(sure | (closest & order)).select("c1", "c2", "z1", "z2", sure.alias("sure")))
    decided = met.where("sure").select("c1", "c2").distinct()
    open_ = met.where("not sure").drop("sure").join(decided, ["c1", "c2"], "left_anti")
    one, two = (side(singles.where("not inf").select("c", "z", "v", "first", "last"), n) for n in (1, 2))
    exact = open_.join(one, ["c1", "z1"]).join(two, ["c2", "z2"]).where(order).where(values_match(F.col("v1"), F.col("v2"), tolerance))
    return cut_lineage(odd.unionAll(decided).unionAll(exact.select("c1", "c2")).distinct())


def similar_groups(
    df: DataFrame, ident: str, entity: str, title: str, region: str, value: str | None,
    entity_least: float = 0.80, title_least: float = 0.82, containment_least: float = 0.60, tolerance: float = 0.05, python: bool = True,
) -> DataFrame:
    """``duplicate_groups`` of ``similar_pairs``, without making the pairs, which grow as the square of the copies of a text.

    Rows of equal texts are linked, so texts are grouped instead of rows. Of two texts that are alike, the
    first row of one and the last of the other tell whether a pair has this order; of two that only share
    words, one pair of matching values is looked for.
    """
    if not (entity_least <= 1 and title_least <= 1 and containment_least > 0 and 1e-6 <= tolerance <= 0.5):  # else the above doesn't hold
        return duplicate_groups(similar_pairs(df, ident, entity, title, region, value, entity_least, title_least, containment_least, tolerance, python))
    number = (F.col(value) if value else F.lit(None)).cast("double").alias("v")
    raw = df.select(F.col(ident).alias("id"), F.col(entity).alias("e0"), F.col(title).alias("t0"), F.col(region).alias("r0"), number).where("id is not null")
    least_most = [F.min("first").alias("first"), F.max("last").alias("last")]
    forms = cut_lineage(raw.groupBy("e0", "t0", "r0").agg(F.min("id").alias("first"), F.max("id").alias("last")))  # else the filter goes before it
    forms = cut_lineage(forms.select("*", *_normal("e0", "t0", "r0")).where("e <> '' and t <> ''"))
    texts = cut_lineage(forms.groupBy("r", "k", "e", "t").agg(*least_most).withColumn("c", F.monotonically_increasing_id()))
    forms = cut_lineage(forms.join(texts.drop("first", "last"), ["r", "k", "e", "t"]).select("e0", "t0", "r0", "c"))

    def placed(of: DataFrame, *columns: str) -> DataFrame:
        """The rows with columns of their form."""
        by = of.select(*[F.col(c).alias(f"f{c}") for c in ("e0", "t0", "r0")], *columns)
        return raw.join(by, F.col("e0").eqNullSafe(F.col("fe0")) & F.col("t0").eqNullSafe(F.col("ft0")) & F.col("r0").eqNullSafe(F.col("fr0"))).select("id", "v", *columns)

    if python:
        linked = cut_lineage(_linked_texts(texts, entity_least, title_least, containment_least).where("c1 <> c2"))
        one, two = texts.select(F.col("c").alias("c1"), F.col("first").alias("first1")), texts.select(F.col("c").alias("c2"), F.col("last").alias("last2"))
        edges = cut_lineage(linked.where("like").join(one, "c1").join(two, "c2").where("first1 < last2").select("c1", "c2"))
        # Where the other order is linked too, by likeness or by shared words, the order of the rows changes no group.
        back = linked.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), F.lit(True).alias("free"))
        sharing = linked.where("not like").join(back, ["c1", "c2"], "left").select("c1", "c2", F.coalesce("free", F.lit(False)).alias("free"))
    else:
        edges = None
        sharing = _sharing_texts(texts, containment_least).withColumn("free", F.lit(True))
    if value:
        if edges is not None:
            done = closure(edges, "c1", "c2").toDF("c", "g")
            one, two = (done.toDF(f"c{n}", f"g{n}") for n in (1, 2))
            sharing = sharing.join(one, "c1", "left").join(two, "c2", "left").where("g1 is null or g2 is null or g1 <> g2").select("c1", "c2", "free")
        sharing = cut_lineage(sharing)
        if not sharing.isEmpty():
            some = sharing.select(F.explode(F.array("c1", "c2")).alias("c")).distinct()
            found = _matching_values(sharing, placed(forms.join(some, "c", "left_semi"), "c"), tolerance)
            edges = found if edges is None else edges.unionAll(found)
    if edges is not None:
        forms = cut_lineage(forms.join(closure(edges, "c1", "c2").toDF("c", "g"), "c", "left").select("e0", "t0", "r0", F.coalesce("g", "c").alias("c")))
    members = cut_lineage(placed(forms, "c").groupBy("id").agg(F.min("c").alias("c"), F.max("c").alias("d")))
    if not members.where("c <> d").isEmpty():  # an ident of several texts links them
        held = placed(forms, "c").join(members.where("c <> d").select("id", F.col("c").alias("b")), "id").select("b", "c")
        joined = closure(held, "b", "c").toDF("c", "g")
        members = cut_lineage(members.join(joined, "c", "left").select("id", F.coalesce("g", "c").alias("c")))
    sizes = members.groupBy("c").agg(F.min("id").alias("least"), F.count("*").alias("miembros")).where("miembros > 1")
    return members.join(dense_numbers(sizes, "least", "dup_grupo"), "c").select("id", "dup_grupo", "miembros")
