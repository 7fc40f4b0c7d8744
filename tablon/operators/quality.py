"""Coverage of fields and the verdict on a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablon.functions.text import is_blank


def coverage(df: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """``[by,] campo, llenos, total, pct, presente``: how often each field isn't blank, in one pass over
    the rows. A missing column counts as empty; an empty frame without ``by`` gives totals of 0."""
    by = by or []
    filled = [F.count_if(~is_blank(F.col(f)) if f in df.columns else F.lit(False)).alias(f"__{i}") for i, f in enumerate(fields)]
    one = df.groupBy(*by).agg(F.count("*").alias("total"), *filled)
    rows = F.array(*[
        F.struct(F.lit(f).alias("campo"), F.col(f"__{i}").alias("llenos"), F.lit(f in df.columns).alias("presente")) for i, f in enumerate(fields)
    ])
    pct = F.coalesce(F.round(F.try_divide(F.col("r.llenos"), F.col("total")), 4), F.lit(0.0))
    return one.select(*by, "total", F.explode(rows).alias("r")).select(*by, "r.campo", "r.llenos", "total", pct.alias("pct"), "r.presente")


def quality_gate(df: DataFrame, least: dict[str, float], signals: dict[str, Column] | None = None, by: list[str] | None = None) -> DataFrame:
    """``[by,] estado, apta, total, motivos``: ``sin_datos`` without rows, ``degradado`` if a field's
    coverage is under its least, ``advertencia`` if a signal (an aggregate) is true, else ``ok``. Only
    the last two are fit. A missing column has coverage 0."""
    by, signals = by or [], signals or {}
    share = {f: F.avg(F.when(is_blank(F.col(f)), 0.0).otherwise(1.0)) if f in df.columns else F.lit(0.0) for f in least}
    one = df.groupBy(*by).agg(
        F.count("*").alias("total"), *[c.alias(f"__c{i}") for i, c in enumerate(share.values())], *[c.alias(f"__s{i}") for i, c in enumerate(signals.values())]
    )
    low = [
        F.when(F.coalesce(F.col(f"__c{i}"), F.lit(0.0)) < m, F.concat(F.lit(f"Cobertura de '{f}' "), F.format_number(F.coalesce(F.col(f"__c{i}"), F.lit(0.0)) * 100, 1), F.lit(f"% < umbral {m:.0%}")))
        for i, (f, m) in enumerate(least.items())
    ]
    warned = [F.when(F.col(f"__s{i}"), F.lit(name)) for i, name in enumerate(signals)]
    blocks = F.array_compact(F.array(*low)) if low else F.array().cast("array<string>")
    warnings = F.array_compact(F.array(*warned)) if warned else F.array().cast("array<string>")
    state = F.when(F.col("total") == 0, "sin_datos").when(F.size(blocks) > 0, "degradado").when(F.size(warnings) > 0, "advertencia").otherwise("ok")
    return one.select(*by, state.alias("estado"), state.isin("ok", "advertencia").alias("apta"), "total", F.concat(blocks, warnings).alias("motivos"))
