"""Canonical links and the keys that are made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*:)?"
_REST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?([^?#]*)"


def canonical_link(link: Column) -> Column:
    """Scheme in lower case; parameters, query, fragment and all trailing slashes dropped.
    Null gives ''."""
    text = F.trim(link)
    scheme = F.lower(F.regexp_extract(text, _SCHEME, 1))
    rest = F.regexp_replace(F.regexp_extract(text, _REST, 1), r";[^/]*$", "")
    return F.coalesce(F.regexp_replace(F.concat(scheme, rest), r"/+$", ""), F.lit(""))


def link_hash(link: Column, length: int = 16) -> Column:
    """Prefix of the SHA-1 of the canonical link."""
    return F.substring(F.sha1(canonical_link(link)), 1, length)


def _part(value: Column) -> Column:
    return F.coalesce(F.trim(value.cast("string")), F.lit(""))


def _or(value: Column, default: str) -> Column:
    text = F.lower(_part(value))
    return F.when(text == "", F.lit(default)).otherwise(text)


def publication_id(
    sector: Column, portal: Column, operation: Column, link: Column, posting: Column
) -> Column:
    """``sector:portal:operation:posting:<id>``, or ``...:url:<hash>`` where the posting is
    blank; blank parts become ``sin_sector``, ``sin_portal``, ``sin_operacion``."""
    tail = F.when(_part(posting) != "", F.concat(F.lit("posting:"), _part(posting))).otherwise(
        F.concat(F.lit("url:"), link_hash(link))
    )
    return F.concat_ws(
        ":", _or(sector, "sin_sector"), _or(portal, "sin_portal"), _or(operation, "sin_operacion"), tail
    )


def with_publication_id(
    df: DataFrame, sector: Column, portal: str = "portal", operation: str = "tipo_operacion", posting: str = "posting_id",
    link: str = "enlace", out: str = "publicacion_id",
) -> DataFrame:
    """``df`` with ``publication_id`` of its columns; those that it lacks count as null."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.withColumn(out, publication_id(sector, has(portal), has(operation), has(link), has(posting)))


def record_key(
    sector: Column, portal: Column, scope_field: Column, operation: Column, link: Column
) -> Column:
    """Key of a listing's state row: five stripped parts, joined by ``|``."""
    return F.concat_ws(
        "|", _part(sector), _part(portal), _part(scope_field), _part(operation), canonical_link(link)
    )


def safe_slug(value: Column) -> Column:
    """Lower case; runs outside ``a-z0-9_-`` become ``_``; none left gives ``sin_valor``."""
    slug = F.btrim(F.regexp_replace(F.lower(_part(value)), r"[^a-z0-9_-]+", "_"), F.lit("_"))
    return F.when(slug == "", F.lit("sin_valor")).otherwise(slug)
