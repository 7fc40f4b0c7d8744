"""Mixing sources to target shares of tokens."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablon.session import cut_lineage

BLOCKS = 256  # blocks of a source's permutation at least: sums of blocks are all that is ordered as a whole
ROWS_PER_BLOCK = 100_000


def temperature_shares(
    sizes: dict[str, int], entropy: float | None = None, most: dict[str, int] | None = None, total: float | None = None, base: dict[str, float] | None = None
) -> tuple[float, dict[str, float]]:
    """The exponent and the shares of sources by temperature: ``base`` shares (equal ones if none are given) times
    the ratio of natural to base shares raised to it. 0 gives the base shares, 1 the natural ones; without ``base``
    the shares are the natural ones raised to the exponent.

    The exponent is the least from 0 to 1, found by bisection, at which the shares have no more than ``entropy``
    (nats), if given, and no source is repeated beyond its limit in a mixture of ``total`` tokens, if ``most`` and ``total``
    are. Sources without tokens or of no base share get none.
    """
    live = {s: n for s, n in sizes.items() if n > 0 and (base is None or base.get(s, 0) > 0)}
    if not live:
        return 1.0, {}
    given = {s: 1.0 if base is None else base[s] for s in live}
    ratios = {s: math.log(n / given[s]) for s, n in live.items()}
    top = max(ratios.values())

    def shares(power: float) -> dict[str, float]:
        raised = {s: given[s] * math.exp(power * (ratios[s] - top)) for s in live}
        return {s: x / sum(raised.values()) for s, x in raised.items()}

    def least(holds) -> float:
        low, high = 0.0, 1.0
        if holds(shares(low)):
            return low
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if holds(shares(middle)) else (middle, high)
        return high

    power = 0.0
    if entropy is not None:
        power = least(lambda q: -sum(x * math.log(x) for x in q.values() if x > 0) <= entropy)
    if most is not None and total is not None:
        power = max(power, least(lambda q: all(q[s] * total <= most.get(s, 1) * n * (1 + 1e-9) for s, n in live.items())))
    return power, shares(power)


def mixture_budgets(
    sizes: dict[str, int], weights: dict[str, float], most: dict[str, int], total: int | None = None
) -> dict[str, float]:
    """Tokens that each source gives. Weights of sources that have no tokens fall to the others in
    proportion. Without ``total``, it is the greatest at which every source has its share within its
    repetitions. With one beyond that, sources at their limit give all they can and the rest is
    shared among the others, again by their weights, until all are at their limits."""
    live = {s: w for s, w in weights.items() if sizes.get(s, 0) > 0 and w > 0 and most.get(s, 1) > 0}
    if not live:
        return {}
    norm = sum(live.values())
    room = {s: most.get(s, 1) * sizes[s] for s in live}
    if total is None:
        total = min(room[s] * norm / live[s] for s in live)
    budget: dict[str, float] = {}
    rest, open_ = min(float(total), float(sum(room.values()))), dict(live)
    while open_:
        norm = sum(open_.values())
        full = [s for s in open_ if rest * open_[s] / norm >= room[s]]
        if not full:
            return budget | {s: rest * w / norm for s, w in open_.items()}
        for s in full:
            budget[s] = room[s]
            del open_[s]
        rest -= sum(room[s] for s in full)
    return budget


def tempered_budgets(
    sizes: dict[str, int], weights: dict[str, float], most: dict[str, int], total: int | None = None, entropy: float | None = None
) -> tuple[float, dict[str, float]]:
    """The exponent of a mixture, and the tokens that each source gives.

    Shares are those of ``temperature_shares`` from ``weights``. Without ``total`` it is the greatest at which the weights
    themselves hold within all repetitions, so that the exponent is 0 (unless ``entropy`` asks for more); with a greater
    one the shares move towards the natural ones, as far as the repetition limits need. What no
    exponent allows is cut to the limits (``mixture_budgets``)."""
    live = {s: w for s, w in weights.items() if sizes.get(s, 0) > 0 and w > 0 and most.get(s, 1) > 0}
    if not live:
        return 1.0, {}
    have = {s: sizes[s] for s in live}
    size = total if total is not None else (sum(mixture_budgets(have, live, most).values()) if entropy is None else None)
    power, shares = temperature_shares(have, entropy, most if size is not None else None, size, live)
    return power, mixture_budgets(have, shares, most, total)


def source_sizes(docs: DataFrame, source: str, tokens: str) -> dict[str, int]:
    """Tokens of each source; as many rows as sources that a target names."""
    return {r[0]: int(r[1] or 0) for r in docs.groupBy(source).agg(F.sum(tokens)).collect()}


def realise(docs: DataFrame, budgets: dict[str, float], source: str, tokens: str, ident: Column, seed: int = 7) -> DataFrame:
    """Rows of ``docs`` as the mixture has them, with ``copia`` (1, 2, ...), for sources with a budget.

    Every source is a seeded permutation of its rows, in blocks by hash, BLOCKS of them or as many as
    have about ROWS_PER_BLOCK rows, anew for each copy.
    Copies that fit the budget are taken whole. Of the last one, rows that are longer than what is
    left are passed over; whole blocks are taken in order as long as they fit, and rows of the
    one block at the border as long as their middle is within the budget. So only sums of blocks and the border blocks are ordered, never a source.
    """
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, float(b)) for s, b in budgets.items()] or [], "s string, budget double")
    sums = docs.groupBy(F.col(source).alias("s")).agg(
        F.sum(tokens).alias("size"), F.greatest(F.lit(BLOCKS), F.ceil(F.count("*") / ROWS_PER_BLOCK)).alias("blocks")
    ).where("size > 0")
    plan = plan.join(sums, "s").withColumn("whole", F.floor(F.col("budget") / F.col("size") + 1e-9).cast("int"))
    plan = F.broadcast(plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("size")))  # a row for each source named
    key = F.xxhash64(F.lit(seed), ident)
    rows = docs.withColumn("__order", key).join(plan, docs[source] == F.col("s"))
    taken = rows.where("whole > 0").withColumn("copia", F.explode(F.sequence(F.lit(1), F.col("whole"))))
    part = rows.where((F.col("rest") > 0) & (F.col(tokens) <= F.col("rest"))).withColumn("__o", F.xxhash64("__order", "whole")).withColumn("__block", F.pmod(F.col("__o"), F.col("blocks")))
    blocks = part.groupBy("s", "__block").agg(F.sum(tokens).alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("s").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("s", "__block", before.alias("start"), "t")
    placed = part.join(starts, ["s", "__block"])
    inner = placed.where("start + t <= rest")
    border = placed.where("start < rest and start + t > rest")
    run = F.sum(tokens).over(Window.partitionBy("s", "__block").orderBy("__o", "__order").rowsBetween(Window.unboundedPreceding, 0))
    edge = border.withColumn("__until", run).where(F.col("start") + F.col("__until") - F.col(tokens) / 2 <= F.col("rest"))
    columns = [*docs.columns]
    last = (F.col("whole") + 1).alias("copia")
    return taken.select(*columns, "copia").unionAll(inner.select(*columns, last)).unionAll(edge.select(*columns, last))


def mix_sources(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, entropy: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (``doc_id, source, tokens, copia``) and its report, from documents (``doc_id, source,
    tokens``) and targets (``source, peso_objetivo, max_repeticiones``).

    Documents of sources without a target, of null source and of no tokens aren't used. A source is
    given its share of the tokens to within a document. Shares come from ``tempered_budgets``: the targets themselves
    unless ``total`` or ``entropy`` needs others. The report has a row for each target, also
    for sources without documents: tokens there are and taken, repetitions, target, planned and actual share, and the exponent.
    """
    wanted = {r["source"]: r for r in targets.where("source is not null").collect()}  # the mixture's parameters
    used = docs.where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0)).select("doc_id", "source", "tokens")
    sizes = source_sizes(used, "source", "tokens")
    power, budgets = tempered_budgets(
        sizes, {s: float(r["peso_objetivo"] or 0) for s, r in wanted.items()},
        {s: int(r["max_repeticiones"] or 0) for s, r in wanted.items()}, total, entropy,
    )
    mixed = realise(used, budgets, "source", "tokens", F.struct("doc_id", "tokens"), seed)
    given = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens_mezcla"), F.count("*").alias("documentos_mezcla"), F.max("copia").alias("copias"))
    there = used.groupBy("source").agg(F.sum("tokens").alias("tokens_fuente"), F.count("*").alias("documentos_fuente"))
    report = targets.where("source is not null").join(there, "source", "left").join(given, "source", "left").na.fill(
        0, ["tokens_fuente", "documentos_fuente", "tokens_mezcla", "documentos_mezcla", "copias"]
    )
    whole = sum(budgets.values()) or 1.0
    plan = docs.sparkSession.createDataFrame([(s, b / whole) for s, b in budgets.items()], "source string, __plan double")
    report = report.join(F.broadcast(plan), "source", "left").na.fill(0.0, ["__plan"])  # a row for each target
    everything = given.agg(F.sum("tokens_mezcla").alias("__all"))
    report = report.crossJoin(F.broadcast(everything)).select(  # one row
        "source", "peso_objetivo", "max_repeticiones", "documentos_fuente", "tokens_fuente", "documentos_mezcla", "tokens_mezcla",
        "copias", F.round(F.try_divide("tokens_mezcla", "tokens_fuente"), 6).alias("repeticiones"),
        F.round(F.try_divide("tokens_mezcla", "__all"), 6).alias("participacion"), F.round("__plan", 6).alias("participacion_prevista"), F.lit(round(power, 9)).alias("exponente"),
    )
    return mixed, report


def tempered(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, tokens_fuente, natural, exponente, participacion``: shares of the target's sources by
    temperature: the natural shares raised to the exponent at which they have the target's entropy and
    no source is repeated beyond its limit in a mixture as large as all sources once."""
    wanted = {r["source"]: r for r in targets.where("source is not null").collect()}
    sizes = {s: n for s, n in source_sizes(docs.where(F.col("source").isin(list(wanted))), "source", "tokens").items() if n}
    weights = [float(r["peso_objetivo"] or 0) for s, r in wanted.items() if s in sizes]
    entropy = -sum(w / sum(weights) * math.log(w / sum(weights)) for w in weights if w > 0) if sum(weights) else None
    power, shares = temperature_shares(sizes, entropy, {s: int(r["max_repeticiones"] or 0) for s, r in wanted.items()}, float(sum(sizes.values())))
    rows = [(s, n, round(n / sum(sizes.values()), 6), round(power, 6), round(shares[s], 6)) for s, n in sizes.items()]
    return docs.sparkSession.createDataFrame(rows, "source string, tokens_fuente bigint, natural double, exponente double, participacion double")


def counted(docs: DataFrame, count) -> DataFrame:
    """``doc_id, source, tokens`` of documents, counted once."""
    return cut_lineage(count(docs.select("doc_id", "source", "text")).select("doc_id", "source", "tokens"))
