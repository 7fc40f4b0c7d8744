"""Quantities in different units: a graph of conversions, composed once, joined on the unit."""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablon.functions.text import strip_accents
from tablon.operators.asof import asof_backward
from tablon.session import cut_lineage

Matrix = tuple[Fraction, Fraction, Fraction, Fraction]
IDENTITY: Matrix = (Fraction(1), Fraction(0), Fraction(0), Fraction(1))


def _times(m: Matrix, n: Matrix) -> Matrix:
    a, b, c, d = m
    e, f, g, h = n
    return (a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h)


def _inverse(m: Matrix) -> Matrix:
    a, b, c, d = m
    return (d, -b, -c, a)


def _unit(m: Matrix) -> Matrix:
    """The same function, in one form: divided by the last entry that isn't 0."""
    k = next(x for x in reversed(m) if x)
    return tuple(x / k for x in m)  # type: ignore[return-value]


@dataclass(frozen=True)
class Conversion:
    """``target = (a * source + b) / (c * source + d)``. Affine where c is 0; the form also
    holds units that are reciprocals of each other (dollars per sol, soles per dollar)."""

    source: str
    target: str
    matrix: Matrix


def affine(source: str, target: str, scale: Fraction | int | str, offset: Fraction | int | str = 0) -> Conversion:
    return Conversion(source, target, (Fraction(scale), Fraction(offset), Fraction(0), Fraction(1)))


def reciprocal(source: str, target: str) -> Conversion:
    return Conversion(source, target, (Fraction(0), Fraction(1), Fraction(1), Fraction(0)))


class UnitGraph:
    """Units as nodes, conversions as edges that run either way."""

    def __init__(self, conversions: Iterable[Conversion]):
        self.edges: dict[str, list[tuple[str, Matrix]]] = defaultdict(list)
        for e in conversions:
            if e.matrix[0] * e.matrix[3] == e.matrix[1] * e.matrix[2]:
                raise ValueError(f"{e.source} to {e.target} can't be inverted")
            self.edges[e.source].append((e.target, e.matrix))
            self.edges[e.target].append((e.source, _inverse(e.matrix)))

    def to(self, target: str) -> dict[str, Matrix]:
        """For every unit that reaches ``target``, its shortest composition to it. Raises
        ValueError where two ways disagree, that is, where a cycle doesn't return its input."""
        found, queue = {target: IDENTITY}, deque([target])
        while queue:
            here = queue.popleft()
            for there, matrix in self.edges[here]:
                way = _unit(_times(found[here], _inverse(matrix)))
                if there not in found:
                    found[there] = way
                    queue.append(there)
                elif _unit(found[there]) != way:
                    raise ValueError(f"the ways from {there} to {target} disagree")
        return found

    def table(self, spark: SparkSession, targets: Iterable[str]) -> DataFrame:
        """``unit, target, a, b, c, d``: one row for each unit and canonical target; as many
        rows as the graph has units, whatever the data's size. The entries are whole numbers without a
        common divisor, so the table is exact; they are as wide as the widest needs."""
        rows = [
            (unit, target, *map(Decimal, _whole_entries(matrix)))
            for target in targets
            for unit, matrix in self.to(target).items()
        ]
        digits = max((len(str(abs(int(x)))) for row in rows for x in row[2:]), default=1)
        if digits > MOST_DIGITS:
            raise ValueError(f"conversions of over {MOST_DIGITS} digits")
        number = f"decimal({digits},0)"
        return spark.createDataFrame(
            rows, f"unit string, target string, a {number}, b {number}, c {number}, d {number}"
        )


MOST_DIGITS = 18


def _whole_entries(m: Matrix) -> list[int]:
    """The same function with whole entries."""
    wide = math.lcm(*(x.denominator for x in m))
    whole = [int(x * wide) for x in m]
    common = math.gcd(*whole) * (-1 if next(x for x in reversed(whole) if x) < 0 else 1)
    return [x // common for x in whole]


def as_fraction(df: DataFrame, table: DataFrame, value: str, unit: str, out: str, out_unit: str) -> DataFrame:
    """Adds ``<out>_arriba`` and ``<out>_abajo`` (decimal(38,9)), whose quotient is ``value`` in the canonical unit
    ``out_unit`` of its unit: nothing is divided, so nothing is lost.

    An equi-join on the unit; the table is broadcast, since it has a row per unit of the graph. Values
    have nine decimals and, before the point, 27 digits less those of the table's widest entry; wider ones,
    null values, and unknown or null units give nulls. No row is lost and none ends the job.
    """
    t = F.broadcast(
        table.select(
            F.col("unit").alias("__unit"), F.col("target").alias("__target"),
            *[F.col(x).alias(f"__{x}") for x in "abcd"],
        )
    )
    x = F.col(value).try_cast(f"decimal({36 - table.schema['a'].dataType.precision},9)")
    line = lambda k, m: F.try_add(F.try_multiply(x, F.col(k)), F.col(m)).try_cast("decimal(38,9)")
    made = (f"{out}_arriba", f"{out}_abajo", out_unit)
    return df.join(t, df[unit] == t["__unit"], "left").select(
        *[df[c] for c in df.columns if c not in made],
        line("__a", "__b").alias(made[0]), line("__c", "__d").alias(made[1]), F.col("__target").alias(out_unit),
    )


def convert(df: DataFrame, table: DataFrame, value: str, unit: str, out: str, out_unit: str) -> DataFrame:
    """Adds ``out`` (decimal(38,12)) and ``out_unit``: ``value`` in the canonical unit of its unit, as
    ``as_fraction`` has it. The one division comes last: a quotient has 12 decimals where its upper number has
    up to 16 digits before the point and its lower one up to 10, else 6. A division by 0 gives null.
    Clashing column names don't matter: only the two new names are added."""
    parts = as_fraction(df, table, value, unit, "__x", out_unit)
    top, below = F.col("__x_arriba"), F.col("__x_abajo")
    quotient = F.coalesce(
        F.try_divide(top.try_cast("decimal(25,9)"), below.try_cast("decimal(19,9)")).try_cast("decimal(38,12)"),
        F.try_divide(top, below).try_cast("decimal(38,12)"),
    )
    exact = F.when(below == 1, top.try_cast("decimal(38,12)")).otherwise(quotient)
    return parts.select(*[parts[c] for c in df.columns if c not in (out, out_unit)], exact.alias(out), F.col(out_unit))


def rounded_product(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """The product of two positive fractions (``as_fraction``) as a whole number, halves up: exact, by the
    remainder of one division, where the first has up to 16 digits before the point and 6 decimals above and is
    whole below, and the second has up to 6 digits above and 10 below. Wider ones are rounded from 6 decimals.
    Null beyond a bigint."""
    top = F.try_multiply(a[0].try_cast("decimal(22,6)"), b[0].try_cast("decimal(15,9)"))
    below = F.try_multiply(a[1].try_cast("decimal(10,0)"), b[1].try_cast("decimal(19,9)"))
    rest = F.try_mod(top, below)
    exact = F.try_divide(F.try_subtract(top, rest), below).try_cast("decimal(25,0)") + F.when(rest >= below - rest, 1).otherwise(0)
    wide = F.try_divide(F.try_multiply(a[0], b[0]), F.try_multiply(a[1], b[1]))
    return F.coalesce(exact.try_cast("bigint"), F.floor(F.try_add(wide, F.lit("0.5").cast("decimal(2,1)"))).try_cast("bigint"))


# The currencies' spellings, as patterns over lower-case text without accents.
# The order matters: "$" alone is the US dollar.
CURRENCIES = [
    ("CLP", r"clp|chilen"),
    ("BRL", r"r\$|brl|\breales\b|\breal\b"),
    ("EUR", r"\beur|€"),
    ("USD", r"usd?\s?\$|u\$s|usd|dolar|\$"),
    ("PEN", r"(?<![a-z])s/|\bsol(es)?\b|\bpen\b"),
]
# Spellings of scales, and the scales as factors.
SCALES = [
    ("centi", r"\bcentavos?\b|\bcents?\b|\bcentimos?\b|\bcts?\b|\bctvs?\b"),
    ("millon", r"\bmillon(es)?\b|\bmill\b|\bmm\b"),
    ("mil", r"\bmil(es)?\b|\b1[., ]?000\b"),
]
FACTORS = {"centi": Fraction(1, 100), "uno": Fraction(1), "mil": Fraction(1000), "millon": Fraction(10**6)}
FOREIGN = ["USD", "EUR", "BRL", "CLP"]


def _first(text: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    found = F.lit(default).cast("string")
    for name, pattern in reversed(rules):
        found = F.when(text.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(strip_accents(F.lower(text)), r"(?U)\s+", " "))


def money_graph() -> UnitGraph:
    """Amounts (``mil USD``) and rates (``centi PEN por uno USD``)."""
    edges = []
    for money in ["PEN", *FOREIGN]:
        edges += [affine(f"{s} {money}", f"uno {money}", FACTORS[s]) for s in FACTORS if s != "uno"]
        edges.append(affine(f"millon {money}", f"mil {money}", 1000))
    for money in FOREIGN:
        for over in FACTORS:
            for under in FACTORS:
                here = f"{over} PEN por {under} {money}"
                if over != "uno":
                    edges.append(affine(here, f"uno PEN por {under} {money}", FACTORS[over]))
                if under != "uno":
                    edges.append(affine(here, f"{over} PEN por uno {money}", 1 / FACTORS[under]))
                edges.append(reciprocal(here, f"{under} {money} por {over} PEN"))
    return UnitGraph(edges)


def rate_unit(text: Column) -> Column:
    """Unit of a quote from its text, as ``money_graph`` names it: ``valores en céntimos por US$``
    gives ``centi PEN por uno USD``. A side that names a scale only is in soles. Null if unclear."""
    t = F.regexp_replace(_plain(text), r"^valores en ", "")
    sides = F.split(t, r" (?:por|x) ", 2)
    over, under = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
    over_money, under_money = (_first(s, CURRENCIES, None) for s in (over, under))
    over_money = F.when(over_money.isNull() & over.rlike(SCALES[0][1]), F.lit("PEN")).otherwise(over_money)
    return F.concat(
        _first(over, SCALES, "uno"), F.lit(" "), over_money, F.lit(" por "),
        _first(under, SCALES, "uno"), F.lit(" "), under_money,
    )


# Spanish number words.
NUMBER_WORDS = {
    "un": 1, "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7,
    "ocho": 8, "nueve": 9, "diez": 10, "once": 11, "doce": 12, "trece": 13, "catorce": 14,
    "quince": 15, "dieciseis": 16, "diecisiete": 17, "dieciocho": 18, "diecinueve": 19, "veinte": 20,
    "veintiun": 21, "veintiuno": 21, "veintidos": 22, "veintitres": 23, "veinticuatro": 24,
    "veinticinco": 25, "veintiseis": 26, "veintisiete": 27, "veintiocho": 28, "veintinueve": 29,
    "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80,
    "noventa": 90, "cien": 100, "ciento": 100, "doscientos": 200, "trescientos": 300,
    "cuatrocientos": 400, "quinientos": 500, "seiscientos": 600, "setecientos": 700,
    "ochocientos": 800, "novecientos": 900,
}
AMOUNT = "decimal(26,6)"
_NUMBER = r"\d+(?:[.,' ’´]\d+)*"
_SCALE_AFTER = r"\s*(miles|mil|millones|millon|mill|mm|m|k)?(?![a-z0-9²])"


def _number(token: Column) -> Column:
    """A separator before exactly three digits groups thousands; any other mark is the decimal one."""
    grouped = F.regexp_replace(token, r"[.,' ’´](?=\d{3}(?!\d))", "")
    return F.regexp_replace(F.regexp_replace(grouped, r"[' ’´]", ""), ",", ".").try_cast(AMOUNT)


def _words_value(plain: Column) -> Column:
    """Value of the number words of a text; null without any."""
    words = F.split(plain, r"[^a-z]+")
    table = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    known = F.filter(words, lambda w: F.map_contains_key(table, w) | w.isin("mil", "millon", "millones"))
    whole = "decimal(30,0)"
    number = lambda x: F.lit(x).cast(whole)
    start = F.struct(number(0).alias("total"), number(0).alias("part"))
    add = lambda x, y: F.try_add(x, y).try_cast(whole)
    times = lambda x, n: F.try_multiply(x, F.lit(n).cast("decimal(7,0)")).try_cast(whole)

    def step(acc: Column, w: Column) -> Column:
        total, part = acc["total"], acc["part"]
        million = F.struct(times(F.greatest(add(total, part), number(1)), 1_000_000).alias("total"), number(0).alias("part"))
        thousand = F.struct(add(total, times(F.greatest(part, number(1)), 1000)).alias("total"), number(0).alias("part"))
        plus = F.struct(total.alias("total"), add(part, F.coalesce(table[w], F.lit(0)).cast(whole)).alias("part"))
        return F.when(w.isin("millon", "millones"), million).when(w == "mil", thousand).otherwise(plus)

    value = F.aggregate(known, start, step, lambda acc: add(acc["total"], acc["part"]))
    return F.when(F.size(known) > 0, value.try_cast(AMOUNT))


def with_stated_amounts(df: DataFrame, price: str, money: str) -> DataFrame:
    """``df`` with ``amount`` (decimal(26,6)) and ``unit`` as ``price`` and ``money`` state them; rows that don't are
    left out. Columns of these names are replaced.

    The number is the first one of ``price``, else its number words. ``k``, ``mil``, ``MM`` and
    the like behind it are its scale. The unit is that of ``price``'s own currency, else all of
    ``money`` (``céntimos de sol``), whose scale then also holds. Amounts of more than 20 digits
    before the point are none. Each text is folded, and searched for its number, once.
    """
    held = [c for c in df.columns if c not in ("amount", "unit")]
    folded = df.select(*held, _plain(F.col(price)).alias("__p"), _plain(F.col(money)).alias("__m"))
    p, m = F.col("__p"), F.col("__m")
    scaled = f"({_NUMBER}){_SCALE_AFTER}"
    cut = folded.select(
        "*", F.regexp_extract(p, scaled, 1).alias("__token"), F.regexp_extract(p, scaled, 2).alias("__scale"),
        F.regexp_extract(p, f"({_NUMBER})", 1).alias("__first"), _first(F.regexp_replace(p, _NUMBER, " "), CURRENCIES, None).alias("__own"),
    )
    factor = (
        F.when(F.col("__scale").isin("k", "mil", "miles"), F.lit(1000))
        .when(F.col("__scale").isin("m", "mm", "mill", "millon", "millones"), F.lit(1_000_000))
        .otherwise(F.lit(1))
    )
    token = F.when(F.col("__token") != "", F.col("__token")).otherwise(F.col("__first"))
    digits = F.try_multiply(_number(token), factor.cast("decimal(8,0)")).try_cast(AMOUNT)
    amount = F.when(F.col("__first") != "", digits).otherwise(_words_value(p))
    unit = F.when(F.col("__own").isNotNull(), F.concat(F.lit("uno "), F.col("__own"))).otherwise(
        F.concat(_first(m, SCALES, "uno"), F.lit(" "), _first(m, CURRENCIES, None))
    )
    return cut.select(*held, amount.alias("amount"), unit.alias("unit")).where("amount is not null and unit is not null")


def soles_per_unit(quotes: DataFrame) -> DataFrame:
    """Quotes with ``soles_arriba, soles_abajo``, whose quotient is the soles per one unit of ``divisa``: ``venta``
    converted from the unit that ``unidad`` or else ``nota`` states. Quotes of unclear unit, or without ``venta``, are left out."""
    graph = money_graph()
    table = graph.table(quotes.sparkSession, [f"uno PEN por uno {m}" for m in FOREIGN])
    stated = quotes.select(
        "series_codigos", "fecha", "tc_id", "venta",
        F.coalesce(rate_unit(F.col("unidad")), rate_unit(F.col("nota"))).alias("__rate_unit"),
    )
    return (
        as_fraction(stated, table, "venta", "__rate_unit", "soles", "__to")
        .where("soles_arriba > 0 and soles_abajo > 0")
        .select("series_codigos", "fecha", "tc_id", "soles_arriba", "soles_abajo", F.substring_index("__to", " ", -1).alias("divisa"))
    )


def amounts_in_soles(listings: DataFrame, runs: DataFrame, quotes: DataFrame) -> DataFrame:
    """``anuncio_id, soles``: every listing whose price states an amount in a stated currency.

    Foreign amounts are multiplied by the soles per unit of the latest quote of the listing's
    series at or before its run; without series, run or such a quote, or if the series is of
    another currency, there is no row. Whole soles, halves up, by exact fractions (``rounded_product``);
    beyond a bigint there is no row. A listing delivered twice counts once. The quotes are looked up
    once for each (series, run), not for each listing.
    """
    spark = listings.sparkSession
    graph = money_graph()
    once = listings.select("anuncio_id", "precio", "moneda", "serie_tc", "corrida_id").dropDuplicates(["anuncio_id"])
    stated = with_stated_amounts(once, "precio", "moneda").select("anuncio_id", "serie_tc", "corrida_id", "amount", "unit")
    table = graph.table(spark, [f"uno {m}" for m in ["PEN", *FOREIGN]])
    units = as_fraction(stated, table, "amount", "unit", "importe", "en").where("importe_arriba is not null")
    # Read three times below, so texts are parsed once.
    units = cut_lineage(units.select("anuncio_id", "serie_tc", "corrida_id", "importe_arriba", "importe_abajo", F.substring_index("en", " ", -1).alias("divisa")))
    foreign = units.where("divisa <> 'PEN' and serie_tc is not null and corrida_id is not null")
    moments = (
        foreign.select("serie_tc", "corrida_id").distinct()
        .join(runs.select("corrida_id", F.col("fecha").alias("__run_at")), "corrida_id")
    )
    # Written first: inlined into the join's aggregates, the texts' patterns make more code than a method may have.
    rates = asof_backward(
        moments, cut_lineage(soles_per_unit(quotes)), {"serie_tc": "series_codigos"}, ("__run_at", "fecha"),
        {"soles_arriba": "tasa_arriba", "soles_abajo": "tasa_abajo", "divisa": "divisa"}, tie="tc_id",
    )
    amount = (F.col("importe_arriba"), F.col("importe_abajo"))
    one = F.lit(1).cast("decimal(38,9)")
    local = units.where("divisa = 'PEN'").select("anuncio_id", rounded_product(amount, (one, one)).alias("soles"))
    abroad = foreign.join(rates.where("tasa_arriba is not null"), ["serie_tc", "corrida_id", "divisa"])
    rate = (F.col("tasa_arriba"), F.col("tasa_abajo"))
    return local.unionAll(abroad.select("anuncio_id", rounded_product(amount, rate).alias("soles"))).where("soles is not null")
