"""Currencies in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of both currencies, in capitals without spaces and dots.
ISO_SPELLINGS = {"PEN": ["S/", "PEN", "SOLES"], "USD": ["USD", "US$", "$", "U$S", "DOLARES"]}


def currency_iso(text: Column) -> Column:
    """``PEN`` or ``USD`` for a text that is a spelling of it, case, spaces and dots aside; null for anything else."""
    plain = F.regexp_replace(F.upper(text.cast("string")), "[ .]", "")
    known = F.create_map(*[F.lit(x) for iso, forms in ISO_SPELLINGS.items() for form in forms for x in (form, iso)])
    return F.try_element_at(known, plain)
