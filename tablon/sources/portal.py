"""Portals as a Spark data source: discovered references are partitions, details are rows."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tablon.operators.embedded import find_key, page_state


@dataclass(frozen=True)
class Reference:
    enlace: str
    fuente: str
    id_externo: str | None = None
    operacion: str | None = None


class Portal(Protocol):
    """What a portal's module offers. No client is part of this package; nothing here uses a network. A portal of many
    listings also has ``pages(operation) -> int`` and ``discover_page(operation, n)``: its pages are then the partitions,
    and the driver holds no references."""

    fuente: str

    def discover(self, operation: str) -> Sequence[Reference]: ...

    def detail(self, ref: Reference) -> dict | None: ...


_PORTALS: dict[str, type] = {}


def register_portal(name: str, make: type) -> None:
    """Makes a portal class known by name; executors need the module that does so on their path."""
    _PORTALS[name] = make


@dataclass
class _Slice(InputPartition):
    refs: list


@dataclass
class _Page(InputPartition):
    number: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _portal(self):
        name = self.options["portal"]
        if name in _PORTALS:
            return _PORTALS[name]()
        module, _, cls = name.rpartition(".")
        return getattr(__import__(module, fromlist=[cls]), cls)()

    def partitions(self) -> list[InputPartition]:
        portal = self._portal()
        if hasattr(portal, "pages"):  # pages of a listing are discovered where they are read
            return [_Page(n) for n in range(1, portal.pages(self.options.get("operacion", "")) + 1)] or [_Slice([])]
        refs = list(portal.discover(self.options.get("operacion", "")))
        size = int(self.options.get("tramo", "100"))
        return [_Slice(refs[i : i + size]) for i in range(0, len(refs), size)] or [_Slice([])]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        portal = self._portal()
        for ref in portal.discover_page(self.options.get("operacion", ""), part.number) if isinstance(part, _Page) else part.refs:
            found = portal.detail(ref)
            if found is not None:
                yield (ref.enlace, ref.fuente, ref.id_externo, ref.operacion, json.dumps(found, ensure_ascii=False, default=str))


class PortalSource(DataSource):
    """``spark.read.format("portal").option("portal", "module.Class").option("operacion", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "portal"

    def schema(self) -> str:
        return "enlace string, fuente string, id_externo string, operacion string, detalle string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def listing_references(pages: DataFrame, html: str, key: str, fields: dict[str, str], fallback: str) -> DataFrame:
    """References on listing pages, with what they came from: ``pages`` without ``html``, with ``posicion``, ``enlace`` and
    the ``fields`` (name -> path in a posting), ``via`` (``estado`` or ``html``).

    Postings are the list under ``key`` in the page's embedded state; a page without it is searched for the pattern
    ``fallback``, whose group 1 is a link. Repeats within a page stay; pages without any reference give no row.
    ``fields`` must have ``enlace``."""
    held = [c for c in pages.columns if c != html]
    postings = F.from_json(find_key(key)(page_state(F.col(html))), "array<string>")  # each posting stays JSON
    links = F.regexp_extract_all(html, F.lit(fallback), F.lit(1))
    cut = pages.select(*held, postings.alias("__p"), links.alias("__l"))
    good = F.size(F.coalesce("__p", F.array().cast("array<string>"))) > 0
    parts = F.when(good, F.transform("__p", lambda p: F.struct(p.alias("x"), F.lit("estado").alias("via")))).otherwise(
        F.transform("__l", lambda u: F.struct(F.to_json(F.struct(u.alias("enlace"))).alias("x"), F.lit("html").alias("via")))
    )
    each = cut.select(*held, F.posexplode(parts).alias("posicion", "r"))
    stated = {n: F.when(F.col("r.via") == "html", F.get_json_object("r.x", "$." + n)).otherwise(F.get_json_object("r.x", path)) for n, path in fields.items()}
    return each.select(*held, "posicion", *[c.alias(n) for n, c in stated.items()], F.col("r.via").alias("via")).where("enlace is not null")


def new_references(found: DataFrame, known: DataFrame) -> DataFrame:
    """References whose canonical link (``enlace_canon``) isn't known yet."""
    return found.join(known.select("enlace_canon"), "enlace_canon", "left_anti")


def absolute_url(base: str, path: Column) -> Column:
    """``path`` as it is if it has a scheme, else below ``base``."""
    root = base if base.endswith("/") else urljoin(base, ".")
    return F.when(path.rlike("^https?://"), path).otherwise(F.concat(F.lit(root), F.ltrim(path, F.lit("/"))))
