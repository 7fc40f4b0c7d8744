"""Currency conversion at the rate of a day, with an audit trail."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablon.functions.numbers import round_binary
from tablon.operators.accumulate import keep_last
from tablon.operators.asof import asof_backward
from tablon.session import cut_lineage

MODES = ("venta", "compra", "promedio")


def _rate(mode: str) -> Column:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    return F.round((F.col("compra") + F.col("venta")) / 2, 6) if mode == "promedio" else F.col(mode)


def convert_amounts(
    df: DataFrame, rates: DataFrame, date: str, soles: str, dollars: str, area: str | None = None, mode: str = "venta", by: dict[str, str] | None = None
) -> DataFrame:
    """``df`` with the missing one of both amounts estimated at the latest rate at or before ``date``.

    Only rows with exactly one amount get an estimate; observed columns are never changed. Adds
    ``tc``, ``tc_fecha``, ``tc_modo``, ``soles_estimado``, ``dolares_estimado``, ``imputado`` (names of the estimated
    columns), and with ``area`` (if over 0) both amounts per unit of it. Without an earlier rate all
    are null. ``rates``: ``fecha, compra, venta`` and the columns that ``by`` names. Estimates are rounded to the even
    digit at ties, as Python's ``round`` does.
    """
    quoted = rates.withColumn("__rate", _rate(mode)).where("__rate > 0")
    kept = {"__rate": "tc", "fecha": "tc_fecha"}
    if by:
        joined = asof_backward(df, quoted, by, (date, "fecha"), kept)
    else:
        one = F.lit(1)
        joined = asof_backward(df.withColumn("__one", one), quoted.withColumn("__one", one), {"__one": "__one"}, (date, "fecha"), kept).drop("__one")
    has_s, has_d = F.col(soles).isNotNull(), F.col(dollars).isNotNull()
    est_s = F.when(~has_s & has_d, round_binary(F.col(dollars) * F.col("tc"), 2))
    est_d = F.when(has_s & ~has_d, round_binary(F.col(soles) / F.col("tc"), 2))
    out = joined.withColumns({"soles_estimado": est_s, "dolares_estimado": est_d, "tc_modo": F.when(F.col("tc").isNotNull(), F.lit(mode))})
    names = F.array_compact(F.array(F.when(F.col("soles_estimado").isNotNull(), F.lit(soles)), F.when(F.col("dolares_estimado").isNotNull(), F.lit(dollars))))
    out = out.withColumn("imputado", names)
    if area:
        per = lambda own, est: F.when(F.col(area) > 0, round_binary(F.coalesce(F.col(own), F.col(est)) / F.col(area), 2))
        out = out.withColumns({"soles_por_m2": per(soles, "soles_estimado"), "dolares_por_m2": per(dollars, "dolares_estimado")})
    return out


def missing_range(wanted: DataFrame, cache: DataFrame, column: str, margin: int = 10, by: dict[str, str] | None = None) -> DataFrame:
    """One row (or one for each of ``by``: wanted column -> cache column): ``desde, hasta, dias``, the days to ask a service
    for: from ``margin`` days before the first day of ``column`` that the cache lacks to the last one. No row if it lacks none."""
    keys = by or {}
    days = wanted.select(*keys, F.to_date(column).alias("dia")).dropna().distinct()
    have = cache.select(*[F.col(c).alias(k) for k, c in keys.items()], F.to_date("fecha").alias("dia")).distinct()
    lacking = days.join(have, [*keys, "dia"], "left_anti")
    return lacking.groupBy(*keys).agg(F.date_sub(F.min("dia"), margin).alias("desde"), F.max("dia").alias("hasta"), F.count("*").alias("dias")).where("dias > 0")


def cached_rates(cache: DataFrame, fresh: DataFrame, series: str | Column, source: str, at: Column, by: list[str] | None = None) -> DataFrame:
    """The cache (``fecha`` a date, ``compra, venta, promedio, fuente, series_codigos, descargado_en``) with fresh rates
    (``fecha, compra, venta``): of one day (and ``by``) the fresh one stays, of several fresh ones the last by ``fecha``."""
    named = F.lit(series) if isinstance(series, str) else series
    rows = fresh.where("fecha is not null").select(
        *[c for c in by or [] if c != "series_codigos"], F.to_date("fecha").alias("fecha"), "compra", "venta", F.round((F.col("compra") + F.col("venta")) / 2, 6).alias("promedio"),
        F.lit(source).alias("fuente"), named.alias("series_codigos"), at.alias("descargado_en"), F.col("fecha").alias("__ord"),
    )
    keys = [*(by or []), "fecha"]
    new = keep_last(rows, keys, [F.col("__ord")]).drop("__ord")
    return keep_last(cache.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)), allowMissingColumns=True), keys, [F.col("__age")]).drop("__age")


def rates_by_day(
    wanted: DataFrame, column: str, cache: DataFrame, download: Callable[[date, date], DataFrame] | None, series: str, source: str, at: Column, margin: int = 10
) -> tuple[DataFrame, DataFrame]:
    """``dia, tc_fecha, compra, venta, promedio`` for each distinct day of ``column``: the rate of that day or of the latest
    one before; and the cache with what was fetched. ``download`` is asked once, for the days from ``missing_range``;
    where it fails or is None the cache alone answers. Days before any rate have nulls."""
    gap = missing_range(wanted, cache, column, margin).first()  # one row
    if gap is not None and download is not None:
        try:
            cache = cut_lineage(cached_rates(cache, download(gap["desde"], gap["hasta"]), series, source, at))
        except Exception as error:  # noqa: BLE001  a service that fails leaves the cache
            logging.getLogger("tablon").warning("no rates from the service, only the cache: %s", error)
    days = wanted.select(F.to_date(column).alias("dia")).where("dia is not null").distinct().withColumn("__one", F.lit(1))
    kept = {"fecha": "tc_fecha", "compra": "compra", "venta": "venta", "promedio": "promedio"}
    found = asof_backward(days, cache.withColumn("__one", F.lit(1)), {"__one": "__one"}, ("dia", "fecha"), kept)
    return found.drop("__one"), cache


def rate_history(rates: DataFrame, first: str, last: str) -> DataFrame:
    """Published rates from ``first`` to ``last``, both included; days without one aren't filled."""
    day = F.to_date("fecha")
    return rates.where(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def missing_days(wanted: DataFrame, rates: DataFrame, column: str) -> DataFrame:
    """``dia``: distinct days of ``column`` without a rate."""
    days = wanted.select(F.to_date(column).alias("dia")).where("dia is not null").distinct()
    return days.join(rates.select(F.to_date("fecha").alias("dia")), "dia", "left_anti")
