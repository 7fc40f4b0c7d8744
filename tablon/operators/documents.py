"""Layout and segmentation of printed pages: blocks, columns, tables, notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_text(blocks: DataFrame, page: list[str], width: float = 50.0) -> DataFrame:
    """``page, texto``: texts of a page's text blocks (``x0, y0, tipo, texto``; tipo 0), by column of ``width``, then from the top."""
    order = F.struct(F.bround(F.col("x0") / width).alias("c"), "y0", "x0", "texto")
    rows = blocks.where("tipo = 0").groupBy(*page).agg(F.array_sort(F.collect_list(order)).alias("__b"))
    return rows.select(*page, F.array_join(F.transform("__b", lambda x: x["texto"]), "\n").alias("texto"))


def column_cuts(words: DataFrame, page: list[str], gap: float = 10.0, step: float = 1.0) -> DataFrame:
    """``page, corte``: middles of the bands of a page, on a grid of ``step``, that no word's ``x0..x1`` touches
    and that are ``gap`` wide or more. Intervals are ordered and compared with the furthest end before
    them; the grid is never built."""
    ends = words.groupBy(*page).agg(F.min("x0").alias("__a"))
    cell = lambda c: F.floor((F.col(c) - F.col("__a")) / step)
    spans = words.join(ends, page).select(*page, "__a", cell("x0").alias("__i0"), cell("x1").alias("__i1"))
    before = Window.partitionBy(*page).orderBy("__i0", "__i1").rowsBetween(Window.unboundedPreceding, -1)
    free = spans.withColumn("__p", F.max("__i1").over(before)).where((F.col("__i0") - F.col("__p") - 1) * step >= gap)
    return free.select(*page, (F.col("__a") + (F.col("__p") + 1 + F.col("__i0")) / 2.0 * step).alias("corte"))


def text_rows(words: DataFrame, page: list[str], tolerance: float = 3.0) -> DataFrame:
    """``words`` with ``fila`` (from 0): rows of words whose vertical middles are within ``tolerance`` of the row's
    moving middle. The rule goes word by word down a page, so a page's words are one array, folded
    in the JVM."""
    middle = ((F.col("y0") + F.col("y1")) / 2.0).cast("double")
    word = F.struct(middle.alias("c"), "x0", F.struct(*[c for c in words.columns if c not in page]).alias("w"))
    pages = words.groupBy(*page).agg(F.array_sort(F.collect_list(word)).alias("__ws"))
    start = F.struct(F.lit(-1).alias("row"), F.lit(None).cast("double").alias("m"), F.array().cast("array<int>").alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["m"].isNull() | (F.abs(x["c"] - acc["m"]) > tolerance)
        row = F.when(new, acc["row"] + 1).otherwise(acc["row"])
        m = F.when(new, x["c"]).otherwise((acc["m"] + x["c"]) / 2)
        return F.struct(row.alias("row"), m.alias("m"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    rows = F.aggregate("__ws", start, step, lambda acc: acc["rows"])
    each = pages.select(*page, F.explode(F.arrays_zip(F.transform("__ws", lambda x: x["w"]).alias("w"), rows.alias("fila"))).alias("__z"))
    return each.select(*page, "__z.w.*", "__z.fila").select(*words.columns, "fila")


def table_cells(words: DataFrame, cuts: DataFrame, page: list[str]) -> DataFrame:
    """``page, fila, celdas``: words (with ``fila``) of a row joined by cell, as many cells as the page has columns."""
    edges = cuts.groupBy(*page).agg(F.array_sort(F.collect_list("corte")).alias("__cuts"))
    placed = words.join(edges, page, "left").withColumn("__cuts", F.coalesce("__cuts", F.array().cast("array<double>")))
    column = F.size(F.filter("__cuts", lambda c: (F.col("x0") + F.col("x1")) / 2 > c))
    cells = (
        placed.withColumn("__col", column).where(F.trim("texto") != "").groupBy(*page, "fila", "__cuts", "__col")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", F.trim("texto").alias("t")))), lambda x: x["t"]), " ").alias("celda"))
    )
    rows = cells.groupBy(*page, "fila", "__cuts").agg(F.map_from_entries(F.collect_list(F.struct("__col", "celda"))).alias("__m"))
    every = F.transform(F.sequence(F.lit(0), F.size("__cuts")), lambda i: F.coalesce(F.col("__m")[i], F.lit("")))
    return rows.select(*page, "fila", every.alias("celdas"))


def stream_tables(words: DataFrame, page: list[str], tolerance: float = 3.0, gap: float = 10.0) -> DataFrame:
    """``page, tabla, fila, celdas``: a page's words as one table, by where they stand."""
    cells = table_cells(text_rows(words, page, tolerance), column_cuts(words, page, gap), page)
    return cells.select(*page, F.lit(0).alias("tabla"), "fila", "celdas")


def chosen_tables(lattice: DataFrame | None, stream: DataFrame | None, page: list[str], strategy: str = "auto") -> DataFrame:
    """Rows of tables (``page, tabla, fila, celdas``) with ``metodo``: those by lines, those by words, or (``auto``) by words on
    pages only that have none by lines. ValueError for another strategy."""
    if strategy not in ("auto", "lattice", "stream"):
        raise ValueError("strategy must be auto, lattice or stream")
    by_lines = None if lattice is None else lattice.withColumn("metodo", F.lit("lattice"))
    by_words = None if stream is None else stream.withColumn("metodo", F.lit("stream"))
    if strategy != "auto":
        return by_lines if strategy == "lattice" else by_words
    rest = by_words.join(lattice.select(*page).distinct(), page, "left_anti")
    return by_lines.unionByName(rest.select(*by_lines.columns))


def table_shape(rows: DataFrame, table: list[str]) -> DataFrame:
    """``table, n_filas, n_columnas``: how many rows a table has, and cells its widest row."""
    return rows.groupBy(*table).agg(F.count("*").alias("n_filas"), F.coalesce(F.max(F.size("celdas")), F.lit(0)).alias("n_columnas"))


def notices(pages: DataFrame, text: str, code: str, section: str | None = None, wanted: list[str] | None = None, trim: bool = True) -> DataFrame:
    """``pages`` without its text, with ``orden, codigo, seccion, aviso``: the text before each code is its notice.

    ``code`` and ``section`` are Java patterns; the code is the first group (``code`` may hold no more). A section
    is its pattern's groups, joined, in capitals, without dashes and spaces. Empty notices are left out; of
    those over 600 characters the last paragraph stays. Whole texts are cut by one pass of the pattern.
    """
    codes = F.regexp_extract_all(text, F.lit(code), F.lit(1))
    parts = F.split(text, code, -1)
    rows = pages.select(
        *[c for c in pages.columns if c != text],
        F.posexplode(F.transform(codes, lambda c, i: F.struct(F.trim(c).alias("codigo"), F.get(parts, i).alias("aviso")))).alias("orden", "n"),
    )
    named: Column = F.lit(None).cast("string")
    if section:
        named = F.nullif(F.regexp_replace(F.upper(F.regexp_extract("codigo", section, 1)), r"[-\s]", ""), F.lit(""))
    out = rows.select("*", "n.codigo", F.regexp_replace("n.aviso", r"^\s+|\s+$", "").alias("aviso")).drop("n").where("aviso <> ''")
    out = out.withColumn("seccion", named)
    if wanted:
        out = out.where(F.col("seccion").isin(wanted))
    if trim:
        last = F.regexp_replace(F.element_at(F.split("aviso", r"\n{2,}"), -1), r"^\s+|\s+$", "")
        out = out.withColumn("aviso", F.when(F.length("aviso") > 600, last).otherwise(F.col("aviso")))
    return out
