"""Keeping the last row of a key, and growing tables by it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """One row for each key: the last by ``order``; null keys are equal. Rows that tie in all of ``order``
    are told apart by a hash of their values, so that runs agree."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order], F.xxhash64(*df.columns))
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def accumulate(previous: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both, those of ``new`` in place of earlier ones with the same key; of rows of one
    key within ``new`` the last by ``__ord`` if there is such a column. Columns of either side are
    kept, the new ones' order first. Without an earlier table, or with an empty one, the new rows stay as they are."""
    if previous is None or previous.limit(1).isEmpty():
        return new.drop("__ord")
    own = [k for k in keys if k in new.columns]
    order = [F.col("__age")] + ([F.col("__ord")] if "__ord" in new.columns else [])
    both = new.withColumn("__age", F.lit(1)).unionByName(previous.withColumn("__age", F.lit(0)), allowMissingColumns=True)
    return (keep_last(both, own, order) if own else both).drop("__age", "__ord")


@dataclass(frozen=True)
class Sheet:
    """A named table of a report and the columns that tell its rows apart."""

    name: str
    keys: list[str] = field(default_factory=list)


def accumulate_sheets(previous: dict[str, DataFrame], new: dict[str, DataFrame], sheets: list[Sheet]) -> dict[str, DataFrame]:
    """Each declared sheet, its new rows over its earlier ones; a sheet without new rows keeps its own, one that
    was never there and isn't delivered is left out. Sheets that aren't declared are dropped."""
    out = {}
    for sheet in sheets:
        old, fresh = previous.get(sheet.name), new.get(sheet.name)
        if fresh is not None:
            out[sheet.name] = accumulate(old, fresh, sheet.keys)
        elif old is not None:
            out[sheet.name] = old
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def fill_blank(df: DataFrame, lookup: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """``target`` where it is blank from ``source`` of the row of ``lookup`` with the same keys; of several
    such rows the greatest value. Filled values and null keys stay."""
    side = lookup.groupBy(*keys).agg(F.max(source).alias("__found"))
    blank = F.col(target).isNull() | (F.trim(F.col(target).cast("string")) == "")
    joined = df.join(side, keys, "left")
    return joined.select(*[F.when(blank, F.coalesce("__found", F.col(c))).otherwise(F.col(c)).alias(c) if c == target else F.col(c) for c in df.columns])


def pending(df: DataFrame, lookup: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Rows whose ``target`` is blank and whose keys ``lookup`` lacks."""
    return df.where(F.col(target).isNull() | (F.trim(F.col(target).cast("string")) == "")).join(lookup.select(*keys), keys, "left_anti")
