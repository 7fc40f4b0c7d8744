"""Readers of what runs leave behind: rate series, pages, documents, reference lists."""

from __future__ import annotations

import io
import logging
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablon.functions.identity import safe_slug
from tablon.functions.numbers import rate_number
from tablon.operators.documents import chosen_tables, ordered_text, stream_tables
from tablon.operators.embedded import CHALLENGE

PERIODS = "struct<periods:array<struct<name:string,values:array<string>>>>"
# Months of rate series, Spanish and English.
SERIES_MONTHS = {
    "ene": 1, "jan": 1, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "aug": 8, "set": 9, "sep": 9,
    "oct": 10, "nov": 11, "dic": 12, "dec": 12,
}


def series_day(name: Column) -> Column:
    """Day of a period's name: ``2026-05-16``, ``16/05/2026`` or ``16.May.26``; years of two digits are of this
    century up to 79."""
    t = F.lower(F.trim(name))
    parts = r"^([0-9]{1,2})[ .-]*([a-z]{3})[a-z]*[ .-]*([0-9]{4}|[0-9]{2})$"
    part = lambda i: F.regexp_extract(t, parts, i)
    months = F.create_map(*[F.lit(x) for kv in SERIES_MONTHS.items() for x in kv])
    year = part(3).try_cast("int")
    full = F.when(F.length(part(3)) == 4, year).when(year < 80, year + 2000).otherwise(year + 1900)
    named = F.try_to_date(F.concat_ws("-", full.cast("string"), F.lpad(months[part(2)].cast("string"), 2, "0"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd")
    return F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.try_to_date(t, "dd/MM/yyyy"), F.when(part(1) != "", named))


def rate_series(answers: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """``[keep,] fecha, compra, venta`` from a service's JSON answers (periods with a name and two values); junk behind the
    JSON is tolerated, periods without two rates over 0 are left out."""
    body = F.regexp_extract(F.col(text), r"(?s)^\s*(\{.*\})", 1)
    periods = F.from_json(body, PERIODS)["periods"]
    kept = keep or []
    rows = answers.select(*kept, F.explode(periods).alias("p")).select(
        *kept, series_day(F.col("p.name")).alias("fecha"), rate_number(F.get("p.values", F.lit(0))).alias("compra"), rate_number(F.get("p.values", F.lit(1))).alias("venta")
    )
    return rows.where("fecha is not null and compra > 0 and venta > 0")


def snapshot_facts(pages: DataFrame, html: str, portal: str, operation: str, page: str, stage: str) -> DataFrame:
    """``archivo, portal, operacion, pagina, etapa, titulo, bytes, desafio`` of stored pages."""
    name = F.concat_ws("_", *[safe_slug(F.col(c)) for c in (portal, operation, stage)], F.concat(F.lit("p"), F.col(page).cast("string")))
    title = F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return pages.select(
        F.concat(name, F.lit(".html")).alias("archivo"), F.col(portal).alias("portal"), F.col(operation).alias("operacion"), F.col(page).alias("pagina"), F.col(stage).alias("etapa"),
        title.alias("titulo"), F.octet_length(html).alias("bytes"), F.coalesce(F.substring(html, 1, 20_000).rlike(CHALLENGE), F.lit(False)).alias("desafio"),
    )


def element_text(html: Column, patterns: list[str]) -> Column:
    """Text of the first element that a pattern (its group 1) finds, tags dropped; the first that isn't blank."""
    text = lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, p, 1), r"(?s)<[^>]*>", " "), r"(?U)\s+", " "))
    return F.coalesce(*[F.nullif(text(p), F.lit("")) for p in patterns])


def pdf_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``ruta, pagina, x0, y0, x1, y1, texto, tipo``: blocks of all PDF files under ``path``, pages from 1. Needs PyMuPDF
    on the executors; a file that can't be read gives no rows."""

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz  # PyMuPDF, optional

        for part in parts:
            rows = []
            for name, content in zip(part["path"], part["content"]):
                try:
                    document = fitz.open(stream=io.BytesIO(content), filetype="pdf")
                except Exception:  # noqa: BLE001  unreadable
                    continue
                rows += [(name, n, *map(float, b[:4]), b[4], int(b[6])) for n, page in enumerate(document, 1) for b in page.get_text("blocks") if len(b) >= 7]
            yield pd.DataFrame(rows, columns=["ruta", "pagina", "x0", "y0", "x1", "y1", "texto", "tipo"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInPandas(blocks, "ruta string, pagina int, x0 double, y0 double, x1 double, y1 double, texto string, tipo int")


def page_texts(blocks: DataFrame, page: list[str], width: float = 50.0, noise: str | None = None) -> DataFrame:
    """``page, texto``: texts of pages by columns (``documents.ordered_text``), without what the pattern ``noise`` finds."""
    texts = ordered_text(blocks, page, width)
    return texts.withColumn("texto", F.regexp_replace("texto", noise, "")) if noise else texts


def _open_pdf(content: bytes):
    import fitz  # PyMuPDF, optional

    return fitz.open(stream=io.BytesIO(content), filetype="pdf")


def document_words(files: DataFrame, opener: Callable = _open_pdf) -> DataFrame:
    """``ruta, pagina, x0, y0, x1, y1, texto``: the words of documents (``path, content``), pages from 1. ``opener`` makes
    pages with ``get_text("words")`` of a document's bytes; the default needs PyMuPDF on the executors.
    A document that it can't open gives no rows."""

    def words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, pages in _documents(parts, opener):
            rows = [(name, n, *map(float, w[:4]), str(w[4])) for n, page in enumerate(pages, 1) for w in page.get_text("words")]
            yield pd.DataFrame(rows, columns=["ruta", "pagina", "x0", "y0", "x1", "y1", "texto"])

    return files.select("path", "content").mapInPandas(words, "ruta string, pagina int, x0 double, y0 double, x1 double, y1 double, texto string")


def document_grids(files: DataFrame, opener: Callable = _open_pdf) -> DataFrame:
    """``ruta, pagina, tabla, fila, celdas``: rows of tables with ruled lines, as the reader's ``find_tables`` has them; pages
    without any, or of a reader without it, give no rows."""

    def grids(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, pages in _documents(parts, opener):
            rows = []
            for n, page in enumerate(pages, 1):
                try:
                    tables = page.find_tables().tables
                except Exception:  # noqa: BLE001  an older reader, or a page that it can't read
                    continue
                rows += [(name, n, t, i, ["" if c is None else str(c).strip() for c in row]) for t, table in enumerate(tables) for i, row in enumerate(table.extract())]
            yield pd.DataFrame(rows, columns=["ruta", "pagina", "tabla", "fila", "celdas"])

    return files.select("path", "content").mapInPandas(grids, "ruta string, pagina int, tabla int, fila int, celdas array<string>")


def _documents(parts: Iterator[pd.DataFrame], opener: Callable) -> Iterator[tuple]:
    for part in parts:
        for name, content in zip(part["path"], part["content"]):
            try:
                pages = list(opener(content))
            except Exception:  # noqa: BLE001  unreadable
                continue
            yield name, pages


def document_tables(
    files: DataFrame, strategy: str = "auto", tolerance: float = 3.0, gap: float = 10.0, pages: list[int] | None = None, opener: Callable = _open_pdf
) -> DataFrame:
    """``ruta, pagina, tabla, fila, celdas, metodo``: tables of documents (``path, content``) by ruled lines (``lattice``), by
    the places of words (``stream``), or (``auto``) by lines where a page has such a table, else by words."""
    wanted = lambda df: df if pages is None else df.where(F.col("pagina").isin(pages))
    page = ["ruta", "pagina"]
    lattice = wanted(document_grids(files, opener)) if strategy != "stream" else None
    stream = stream_tables(wanted(document_words(files, opener)), page, tolerance, gap) if strategy != "lattice" else None
    return chosen_tables(lattice, stream, page, strategy)


def reference_or_none(load: Callable[[], DataFrame], names: dict[str, list[str]], header_rows: int = 10) -> DataFrame | None:
    """``reference_list`` of what ``load`` reads; None where that fails or has no such columns."""
    try:
        return reference_list(load(), names, header_rows)
    except Exception as error:  # noqa: BLE001  whatever is wrong, there is no list
        logging.getLogger("tablon").warning("no reference list: %s", error)
        return None


def reference_list(df: DataFrame, names: dict[str, list[str]], header_rows: int = 10) -> DataFrame | None:
    """Columns under their canonical names: those of ``df`` that match a name (case and accents aside), or those of a
    header within the first ``header_rows`` rows (by column ``_orden``). Rows that lack a value are left
    out. None if the columns aren't found."""
    wanted = {n: canonical for canonical, all_names in names.items() for n in all_names}

    def plain(value: object) -> str:
        apart = unicodedata.normalize("NFKD", str(value).strip().lower())
        return "".join(c for c in apart if not unicodedata.combining(c))

    def match(values: dict[str, object]) -> dict[str, str]:
        return {wanted[k]: c for c, v in values.items() if v is not None and (k := plain(v)) in wanted}

    columns = [c for c in df.columns if c != "_orden"]
    found, rows = match({c: c for c in columns}), df
    if len(found) < len(names) and "_orden" in df.columns:
        for head in df.orderBy("_orden").limit(header_rows).collect():  # a header, not data
            found = match({c: head[c] for c in columns})
            if len(found) == len(names):
                rows = df.where(F.col("_orden") > head["_orden"])
                break
    if len(found) < len(names):
        return None
    return rows.select(*[F.col(c).cast("string").alias(n) for n, c in found.items()]).dropna()
