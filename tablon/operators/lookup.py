"""Classification of places by a lookup table: names within districts, names, then names in the text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablon.functions.text import strip_accents
from tablon.session import cut_lineage

# Labels as they are typed, and their canonical ones.
LABELS = {
    "alto": "Alto", "allto": "Alto", "medio alto": "Medio Alto", "media alto": "Medio Alto", "medio": "Medio",
    "medio bajo": "Medio Bajo", "bajo": "Bajo",
}
# Words of streets, of estates, and words that name no place.
STREET = "av|avenida|calle|jr|jiron|pasaje|psje|prolongacion|ovalo|plaza|parque|via"
ESTATE = "urb|urbanizacion|residencial|condominio|asoc|asociacion|coop|cooperativa"
NOT_PLACES = ["venta", "alquiler", "departamento", "departamentos", "casa", "casas", "terreno", "terrenos", "habitacion", "habitaciones", "inmueble", "inmuebles"]
PREFIXES = (
    "urb", "urbanizacion", "residencial", "quinta", "villa", "condominio", "asoc", "asociacion", "coop", "cooperativa",
    "pueblo tradicional", "pueblo joven",
)
LONGEST = 6


def place_text(value: Column) -> Column:
    """Lower case without accents; only letters, digits and ``. / , ; | -`` stay."""
    t = strip_accents(F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))))
    # The characters that stay, the phrases that go, and what is cut off at the ends.
    t = F.regexp_replace(t, r"(?U)[^\w\s./,;|-]", " ")
    t = F.regexp_replace(t, r"\b(en|de|del|la|el|los|las)\s+(venta|alquiler)\b", " ")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"^[ .,;|/-]+|[ .,;|/-]+$", "")


def label(value: Column) -> Column:
    """The canonical label; dashes count as spaces. Null for unknown ones."""
    table = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return table[F.trim(F.regexp_replace(place_text(value), r"[\s-]+", " "))]


@dataclass(frozen=True)
class LookupConfig:
    """What the cascade knows of an area: names of districts (cut off behind a place's name), other names
    of them, words that announce a place, and how many rows make a name known."""

    districts: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)
    prefixes: tuple[str, ...] = PREFIXES
    least: int = 2


DEFAULT = LookupConfig()


def district(value: Column, config: LookupConfig = DEFAULT) -> Column:
    """The district's name as the index has it."""
    t = place_text(value)
    if not config.aliases:
        return t
    return F.coalesce(F.create_map(*[F.lit(x) for kv in config.aliases.items() for x in kv])[t], t)


def _segment(segment: Column, config: LookupConfig) -> Column:
    """The place's name in a part of an address: what a prefix announces, else all, up to an inner street
    word, without small and estate words and without the district behind it; a name that is written
    twice in a row counts once."""
    # The patterns that decide where a name begins and ends.
    announced = rf"\b(?:{'|'.join(config.prefixes)})\.?\s+[a-z0-9\s.-]{{3,60}}"
    found = F.regexp_extract(segment, announced, 0)
    whole = F.when(found != "", found).otherwise(segment)
    lead = F.get(F.split(whole, rf"\b(?:{STREET})\.?\b", 2), F.lit(0))
    t = F.when(F.trim(lead) != "", lead).otherwise(whole)
    t = F.regexp_replace(F.regexp_replace(t, r"\b(en|de|del|la|el|los|las)\b", " "), rf"\b(?:{ESTATE})\b\.?", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ ./-]+|[ ./-]+$", "")
    if config.districts:
        names = "|".join(re.escape(x) for x in sorted(config.districts, key=len, reverse=True))
        t = F.regexp_replace(F.regexp_replace(t, rf" (?:{names})$", ""), r"[ ./-]+$", "")
    return F.regexp_replace(t, r"^(\S+(?: \S+)*) \1$", "$1")


def _is_place(name: Column, config: LookupConfig) -> Column:
    words = F.split(name, " ")
    known = (
        (F.length(name) >= 4) & ~name.rlike(rf"^(?:{STREET})\b") & (F.size(words) <= LONGEST)
        & ~F.forall(words, lambda w: w.isin(NOT_PLACES))
    )
    return known & ~name.isin(list(config.districts)) if config.districts else known


def candidates(*texts: Column, config: LookupConfig = DEFAULT) -> Column:
    """Names of places in texts, in order, each once."""
    lists = [F.transform(F.split(place_text(t), r"[,;|]+"), lambda s: _segment(F.trim(s), config)) for t in texts]
    return F.array_distinct(F.filter(F.concat(*lists), lambda n: _is_place(n, config)))


def _mode(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The most frequent label of each key (of equals the one that came first), its share, the count, and
    where the key came first."""
    per = rows.groupBy(*keys, "nse").agg(F.count("*").alias("n"), F.min("orden").alias("o"))
    best = F.max(F.struct("n", (-F.col("o")).alias("o"), "nse")).alias("b")
    return per.groupBy(*keys).agg(best, F.sum("n").alias("n"), F.min("o").alias("orden")).where(F.col("n") >= least).select(
        *keys, F.col("b.nse").alias("nse"), (F.col("b.n") / F.col("n")).alias("confianza"), "n", "orden"
    )


def build_index(reference: DataFrame, order: str, config: LookupConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Labels by (district, name) and by name, from ``distrito, lugar, nse``; names with fewer rows than
    ``config.least`` are left out, rows without district, place or known label too."""
    rows = reference.select(
        district(F.col("distrito"), config).alias("distrito"), label(F.col("nse")).alias("nse"), F.col(order).alias("orden"),
        F.explode(candidates(F.col("lugar"), config=config)).alias("nombre"),
    ).where("distrito <> '' and nse is not null")
    return _mode(rows, ["distrito", "nombre"], config.least), _mode(rows, ["nombre"], config.least)


def _stretches(text: Column, longest: int) -> Column:
    """All parts of a text that begin and end with a word, of up to ``longest`` words, as they stand in it, with the signs
    between the words."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))
    signs = F.split(text, r"(?U)\w+")  # one before each word, one behind the last
    pieces = F.flatten(F.zip_with(words, F.slice(signs, F.lit(2), F.size(words)), lambda w, s: F.array(w, s)))
    count = F.size(words)
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    reach = lambda i: F.sequence(F.lit(1), F.least(F.lit(longest), count - i))
    part = lambda i, k: F.array_join(F.slice(pieces, 2 * i + 1, 2 * k - 1), "")
    return F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(reach(i), lambda k: part(i, k)))))


def classify(df: DataFrame, index: tuple[DataFrame, DataFrame], ident: str, places: list[str], where: str, config: LookupConfig = DEFAULT) -> DataFrame:
    """``<ident>, nse, metodo, nombre, confianza``: the label of the first name in ``places`` that the index has for
    the district, else of the first that it has at all, else of the longest known name within the texts, its
    district's label first. The last is for rows without a hit only, and an equi-join of the stretches of
    their texts, not a comparison with every name. Null and blank texts give nulls; ids must be unique."""
    local, everywhere = index
    texts = [F.col(p) for p in places]
    rows = cut_lineage(df.select(  # read for each stage; texts are cut once
        F.col(ident).alias("id"), district(F.col(where), config).alias("distrito"), candidates(*texts, config=config).alias("c"),
        place_text(F.concat_ws(" ", *texts)).alias("t"),
    ))
    listed = rows.select("id", "distrito", F.posexplode("c").alias("pos", "nombre"))
    both = listed.join(everywhere.select("nombre", F.col("nse").alias("g"), F.col("confianza").alias("gc")), "nombre").join(
        local.select("distrito", "nombre", F.col("nse").alias("l"), F.col("confianza").alias("lc")), ["distrito", "nombre"], "left"
    )
    here = F.col("l").isNotNull()
    # A name that its district has is one that there is at all, as the wider index has all names of the narrower.
    hit = lambda method, a, b: F.struct(F.col("nombre").alias("nombre"), method.alias("metodo"), F.coalesce(a, b).alias("nse"), F.when(here, F.col("lc")).otherwise(F.col("gc")).alias("confianza"))
    own = hit(F.when(here, "urbanizacion_distrito").otherwise("urbanizacion_global"), F.col("l"), F.col("g"))
    named = both.groupBy("id").agg(F.min_by(own, F.struct(~here, "pos")).alias("h"))
    longest = everywhere.agg(F.max(F.size(F.regexp_extract_all("nombre", F.lit(r"(?U)\w+"), F.lit(0))))).first()[0] or 1  # one number
    long = everywhere.where("length(nombre) >= 8 or nombre like '% %'").select("nombre", "orden", F.col("nse").alias("g"), F.col("confianza").alias("gc"))
    rest = rows.join(named.select("id"), "id", "left_anti").select("id", "distrito", F.explode(_stretches(F.col("t"), longest)).alias("nombre"))
    found = rest.join(long, "nombre").join(local.select("distrito", "nombre", F.col("nse").alias("l"), F.col("confianza").alias("lc")), ["distrito", "nombre"], "left")
    text = found.groupBy("id").agg(F.min_by(hit(F.lit("urbanizacion_texto"), F.col("l"), F.col("g")), F.struct(-F.length("nombre"), "orden")).alias("h"))
    best = named.unionAll(text)
    return rows.select("id").join(best, "id", "left").select(
        F.col("id").alias(ident), F.col("h.nse").alias("nse"), F.col("h.metodo").alias("metodo"), F.col("h.nombre").alias("nombre"), F.round("h.confianza", 4).alias("confianza")
    )


def assigned_share(classified: DataFrame, label_column: str = "nse", by: list[str] | None = None) -> DataFrame:
    """``[by,] filas, asignadas, pct``: rows, those with a label, and their whole percent (down)."""
    one = classified.groupBy(*(by or [])).agg(F.count("*").alias("filas"), F.count(label_column).alias("asignadas"))
    return one.withColumn("pct", F.coalesce(F.floor(F.try_divide(F.col("asignadas") * 100, F.col("filas"))), F.lit(0)).cast("int"))


def commonest(rows: DataFrame, keys: list[str], label_column: str, order: str, least: int = 1) -> DataFrame:
    """``keys, nse, confianza, n, orden``: each key's most frequent label, of equals the one that comes first by ``order``,
    for keys of ``least`` rows or more. Null keys and labels don't count."""
    return _mode(rows.select(*keys, F.col(label_column).alias("nse"), F.col(order).alias("orden")).dropna(subset=[*keys, "nse"]), keys, least)


def first_route(category: Column, portal: Column, by_category: dict[str, list[str]], by_portal: dict[str, list[str]], default: list[str]) -> Column:
    """The files for a category, else for a portal, else the default ones."""
    table = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    known = [F.try_element_at(table(m), c) for m, c in ((by_category, category), (by_portal, portal)) if m]
    return F.coalesce(*known, F.array(*[F.lit(f) for f in default]))
