"""Counters of what runs met on the pages that they visited."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Counters of a run, each with the column of page facts that it adds up.
COUNTERS = {
    "tarjetas_totales": "tarjetas", "detalle_intentos": "intentos", "detalle_exitos": "exitos",
    "postings_redux_totales": "postings", "postings_matcheados": "matcheados",
}
STATE_STRATEGY = "navent"  # the strategy whose pages must have an embedded state


def run_diagnostics(pages: DataFrame, keys: list[str]) -> DataFrame:
    """One row of counters for each of ``keys``, from facts of pages (``estrategia, tarjetas, intentos, exitos,
    postings, matcheados, estado`` (whether the embedded state was read)). Missing columns and nulls count
    as 0; a page of null ``estado`` counts neither as read nor as failed."""
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in pages.columns else F.lit(0)
    state = F.col("estado") if "estado" in pages.columns else F.lit(None).cast("boolean")
    sums = pages.groupBy(*keys).agg(
        F.count("*").alias("paginas_visitadas"), F.count_if(has("tarjetas") > 0).alias("paginas_con_tarjetas"), F.count_if(has("tarjetas") <= 0).alias("paginas_sin_tarjetas"),
        *[F.sum(has(c)).cast("bigint").alias(name) for name, c in COUNTERS.items()],
        F.count_if(state).alias("redux_paginas_ok"), F.count_if(~state).alias("redux_paginas_fallidas"),
        F.coalesce(F.max(F.col("estrategia") == STATE_STRATEGY) if "estrategia" in pages.columns else F.lit(False), F.lit(False)).alias("redux_requerido"),
    )
    return sums.withColumn("ratio_match_redux_dom", F.round(F.try_divide("postings_matcheados", "tarjetas_totales"), 4))
