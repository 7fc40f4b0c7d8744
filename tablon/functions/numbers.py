"""Numbers in text. A comma groups thousands, a dot is the decimal point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_number(text: Column) -> Column:
    """The first run of digits and dots once commas are gone; null if there is none or it is no number
    (``S/. 2,500`` starts with a bare dot, so it gives null)."""
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"[0-9.]+", 0).try_cast("double")


def first_integer(text: Column) -> Column:
    """The first run of digits; null if there is none or it exceeds a bigint."""
    return F.regexp_extract(text, r"[0-9]+", 0).try_cast("bigint")


def round_binary(value: Column, digits: int = 2) -> Column:
    """A double rounded to ``digits`` decimals by its exact binary value, ties to the even digit, as Python's ``round`` does
    (``round`` and ``bround`` go by the shortest decimal text: 2.675 is just under the tie, though it doesn't look so)."""
    scale = 10.0**digits
    x = value.cast("double")
    cents = F.floor(x * scale).cast("double")
    # The value in two halves of few bits each, so that both products are exact, and so is the distance to the tie.
    wide = x * 134217729.0
    high = wide - (wide - x)
    above = (high * (2 * scale) - (cents * 2 + 1)) + (x - high) * (2 * scale)
    up = (above > 0) | ((above == 0) & (F.pmod(cents, F.lit(2.0)) == 1))
    return F.when(F.abs(x) < 2.0**52 / scale, (cents + F.when(up, 1.0).otherwise(0.0)) / scale).otherwise(x)


def rate_number(text: Column) -> Column:
    """A quote's number; null for blanks and the marks of missing ones."""
    plain = F.lower(F.trim(text.cast("string")))
    return F.when(plain.isin("", "n.d.", "nd", "nan", "none"), None).otherwise(
        F.replace(plain, F.lit(","), F.lit("")).try_cast("double")
    )
