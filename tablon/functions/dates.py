"""Spanish dates in words, dates in text, and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish months by their first three letters.
MONTHS = {"ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "set": 9, "sep": 9, "oct": 10, "nov": 11, "dic": 12}


def _date(year: Column, month: Column, day: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), two(month), two(day)), "yyyy-MM-dd")


def relative_date(text: Column, today: Column) -> Column:
    """The date that a phrase means: ``23 may. 2026``; else ``hoy``, ``ayer``, ``hace 3 horas``; else ``hace``
    with weeks, days and months of 30 days, added up. Null for anything else. Full month names
    of five letters and more aren't understood."""
    t = F.lower(F.trim(text))
    # The patterns of phrases, here and below.
    absolute = r"([0-9]{1,2})\s+([a-z]{3,4})\.?\s+([0-9]{4})"
    part = lambda i: F.regexp_extract(t, absolute, i)
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    stated = _date(part(3), months[F.substring(part(2), 1, 3)], part(1))
    count = lambda pattern: F.regexp_extract(t, pattern, 1).try_cast("int")
    weeks, days, thirties = count(r"hace\s+([0-9]+)\s*semana"), count(r"([0-9]+)\s*d[ií]a"), count(r"hace\s+([0-9]+)\s*mes")
    days = F.when(t.contains("hace"), days)
    zero = F.lit(0)
    total = F.coalesce(weeks, zero) * 7 + F.coalesce(days, zero) + F.coalesce(thirties, zero) * 30
    ago = F.when(F.coalesce(weeks, days, thirties).isNotNull(), F.date_sub(today, total))
    return F.coalesce(
        F.when(part(2).isin(*MONTHS) | F.substring(part(2), 1, 3).isin(*MONTHS), stated),
        F.when(t.contains("hoy"), today).when(t.contains("ayer"), F.date_sub(today, 1)).when(t.rlike(r"hace\s+[0-9]+\s*hora"), today).otherwise(ago),
    )


def date_in_text(text: Column) -> Column:
    """The first ``YYYY-MM[-DD]`` (or with ``/``) of a text; a missing day is 1. Null if it is no date."""
    pattern = r"([0-9]{4})[-/]([0-9]{1,2})(?:[-/]([0-9]{1,2}))?"
    part = lambda i: F.regexp_extract(text.cast("string"), pattern, i)
    day = F.when(part(3) == "", "1").otherwise(part(3))
    return F.when(part(1) != "", _date(part(1), part(2), day))


def iso_date(value: Column) -> Column:
    """The date of a timestamp or of a text: ``2026-05-16`` (a time may follow), ``2026/5/16``, ``20260516``, or
    figures with the month first unless that is no month (``05/16/2026``, ``16/05/2026``). Null for anything else."""
    t = F.trim(value.cast("string"))
    year_first = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})(?:[T ].*)?$"
    year_last = r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})(?:[T ].*)?$"
    part = lambda p, i: F.regexp_extract(t, p, i)
    return F.coalesce(
        F.when(part(year_first, 1) != "", _date(part(year_first, 1), part(year_first, 2), part(year_first, 3))),
        F.when(t.rlike("^[0-9]{8}$"), F.try_to_date(t, "yyyyMMdd")),
        F.when(part(year_last, 3) != "", F.coalesce(
            _date(part(year_last, 3), part(year_last, 1), part(year_last, 2)), _date(part(year_last, 3), part(year_last, 2), part(year_last, 1))
        )),
    )


def period(day: Column) -> dict[str, Column]:
    """Year, quarter (``2026-T2``), month (``2026-05``) and both numbers of a date."""
    return {
        "anio": F.year(day),
        "trimestre": F.concat(F.lpad(F.year(day).cast("string"), 4, "0"), F.lit("-T"), F.quarter(day).cast("string")),
        "mes": F.date_format(day, "yyyy-MM"),
        "mes_num": F.month(day),
        "trimestre_num": F.quarter(day),
    }


def with_periods(df, column: str, names: tuple[str, ...] = ("anio", "trimestre", "mes"), prefix: str = ""):
    """Adds period columns of ``column``, null where it is missing from the frame; unknown names are ignored."""
    day = date_in_text(F.col(column)) if column in df.columns else F.lit(None).cast("date")
    return df.withColumns({prefix + k: v for k, v in period(day).items() if k in names})
