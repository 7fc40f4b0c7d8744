"""Text normal forms."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache
def _accent_pairs() -> tuple[str, str]:
    """Letters of U+00C0 to U+024F and U+1E00 to U+1EFF with their base letters."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def strip_accents(text: Column) -> Column:
    """Base letters; combining marks are dropped."""
    source, target = _accent_pairs()
    return F.regexp_replace(F.translate(text, source, target), r"\p{M}+", "")


def normal_text(text: Column) -> Column:
    """Lower case without accents, white space collapsed; null gives ''."""
    plain = strip_accents(F.lower(F.coalesce(text.cast("string"), F.lit(""))))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def hash_text(text: Column) -> Column:
    """Lower case with white space collapsed; accents and punctuation stay. Null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def content_hash(text: Column) -> Column:
    """SHA-256 of ``hash_text``."""
    return F.sha2(hash_text(text), 256)


def is_blank(value: Column) -> Column:
    """True for null, for text without a visible character and for the number NaN (not for the text)."""
    text = F.trim(value.cast("string"))
    return value.isNull() | (text == "") | (F.typeof(value).isin("double", "float") & (text == "NaN"))


def or_null(value: Column) -> Column:
    """Null for the number NaN, else the value."""
    return F.when(~(F.typeof(value).isin("double", "float") & (value.cast("string") == "NaN")), value)


def sorted_json(values: dict[str, Column]) -> Column:
    """JSON of named values, in order of their names, nulls too."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]), {"ignoreNullFields": "false"})


def dedup_text(text: Column) -> Column:
    """Lower case without accents; anything but ``a-z0-9`` becomes one space."""
    plain = F.regexp_replace(strip_accents(F.lower(F.coalesce(text.cast("string"), F.lit("")))), r"[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(plain, r" +", " "))


def token_sort(text: Column) -> Column:
    """Words in order, joined by one space."""
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda w: w != "")), " ")


def block_token(text: Column) -> Column:
    """The first longest word of three letters or more, else of any length; '' for none."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    long = F.filter(words, lambda w: F.length(w) >= 3)
    pool = F.when(F.size(long) > 0, long).otherwise(words)
    return F.aggregate(
        pool, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best)
    )


def token_containment(a: Column, b: Column) -> Column:
    """Shared words over the words of the shorter side, as sets; 0 if either has none."""
    x, y = (F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != "")) for t in (a, b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def values_match(a: Column, b: Column, tolerance: float) -> Column:
    """Both positive and within ``tolerance`` of the larger; false for null and NaN."""
    x, y = a.cast("double"), b.cast("double")
    close = (x > 0) & (y > 0) & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x - y) <= F.lit(tolerance) * F.greatest(x, y))
    return F.coalesce(close, F.lit(False))
