"""Required fields, allowed values and warnings of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablon.functions.text import is_blank

# What a listing must have, and the states there are.
REQUIRED = ["enlace", "portal", "sector", "fecha_extraccion"]
STATES = ["nuevo", "repetido", "desaparecido", "dado de baja"]


def validated(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``errores`` (missing required fields, unknown states, negative absences) and ``warnings`` (names of
    ``rules`` that hold). Missing columns count as missing values; no row is dropped."""
    errors = [F.when(is_blank(F.col(c)) if c in df.columns else F.lit(True), F.lit(c)) for c in REQUIRED]
    if "estado_anuncio" in df.columns:
        errors.append(F.when(~F.col("estado_anuncio").isin(STATES), F.lit("estado_anuncio")))
    if "ausencias_consecutivas" in df.columns:
        errors.append(F.when(F.col("ausencias_consecutivas") < 0, F.lit("ausencias_consecutivas")))
    warned = [F.when(rule, F.lit(name)) for name, rule in (rules or {}).items()]
    none = F.array().cast("array<string>")
    return df.withColumns({"errores": F.array_compact(F.array(*errors)), "warnings": F.array_compact(F.array(*warned)) if warned else none})


def quarantine(df: DataFrame, rules: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows without errors, and rows with."""
    checked = validated(df, rules)
    return checked.where(F.size("errores") == 0).drop("errores"), checked.where(F.size("errores") > 0)


def first_filled(columns: dict[str, Column]) -> Column:
    """``struct<valor, origen>``: the first value that isn't blank, and the name of what it comes from."""
    choice = F.lit(None).cast("struct<valor:string,origen:string>")
    for name, c in reversed(columns.items()):
        choice = F.when(~is_blank(c), F.struct(F.trim(c.cast("string")).alias("valor"), F.lit(name).alias("origen"))).otherwise(choice)
    return choice
