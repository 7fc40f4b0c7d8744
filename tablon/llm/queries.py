"""Queries of the problems on texts and record linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablon.functions.identity import canonical_link
from tablon.llm.addresses import same_address_pairs
from tablon.llm.canonical import listings_entries
from tablon.llm.components import listing_groups
from tablon.llm.lookalikes import lookalike_pairs
from tablon.llm.mixture import counted, mix_sources, tempered
from tablon.llm.nearest import nearest_in_time
from tablon.llm.tokens import count_tokens, encode_texts
from tablon.operators.instants import normal_instants
from tablon.plans.training_queries import P2_SQL
from tablon.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return listings_entries(table(spark, d, "anuncios"), table(spark, d, "distritos"), table(spark, d, "distritos_alias"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return listing_groups(table(spark, d, "anuncios"), table(spark, d, "pares_duplicados"), canonical_link)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    listings = (
        table(spark, d, "anuncios").select("anuncio_id", "portal", "serie_tc", "fecha_publicacion")
        .where("serie_tc is not null and fecha_publicacion is not null").dropDuplicates(["anuncio_id"])
    )
    left = normal_instants(listings, table(spark, d, "portales"), ["fecha_publicacion"])
    # The instant is that of p2, in whole seconds.
    left = left.withColumn("fecha_publicacion_us", F.floor(F.col("fecha_publicacion_us") / 1_000_000).cast("bigint") * 1_000_000)
    right = table(spark, d, "tipo_cambio_bcrp").select(
        "tc_id", "series_codigos", F.unix_micros(F.col("fecha").cast("timestamp")).alias("us")
    )
    found = nearest_in_time(
        left, right, ("anuncio_id", "serie_tc", "fecha_publicacion_us"), ("tc_id", "series_codigos", "us"), 12 * 3600
    )
    return found.select(F.col("left_id").alias("anuncio_id"), F.col("right_id").alias("tc_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return same_address_pairs(table(spark, d, "anuncios"), table(spark, d, "distritos"), table(spark, d, "distritos_alias"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return counted(table(spark, d, "documents"), count_tokens)


def p9_mezcla(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(_counted(spark, d), table(spark, d, "mezcla_fuentes"))[0]


def p9_reporte(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(_counted(spark, d), table(spark, d, "mezcla_fuentes"))[1]


def p9_temperatura(spark: SparkSession, d: str) -> DataFrame:
    return tempered(_counted(spark, d), table(spark, d, "mezcla_fuentes"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(table(spark, d, "documents"))


def _canon_sql(column: str) -> str:
    return (
        f"regexp_replace(lower(regexp_extract(trim({column}), '^([A-Za-z][A-Za-z0-9+.-]*:)?', 1)) || "
        f"regexp_replace(regexp_extract(trim({column}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?([^?#]*)', 1), ';[^/]*$', ''), '/+$', '')"
    )


P4_SQL = f"""
WITH RECURSIVE ids AS (SELECT {_canon_sql("enlace")} AS l, min(anuncio_id) AS id FROM anuncios GROUP BY 1),
p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM pares_duplicados d
      JOIN ids a ON a.l = {_canon_sql("d.enlace_a")} JOIN ids b ON b.l = {_canon_sql("d.enlace_b")}
      WHERE aceptado AND a.id <> b.id),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT a AS anuncio_id, least(a, min(b)) AS grupo_id FROM reach GROUP BY a
"""

P6_SQL = f"""
WITH p AS ({P2_SQL}), l AS (
  SELECT DISTINCT p.anuncio_id, a.serie_tc, make_timestamp(p.segundos_utc * 1000000) AS t FROM p JOIN anuncios a USING (anuncio_id) WHERE campo = 'fecha_publicacion' AND serie_tc IS NOT NULL),
n AS (
  SELECT l.anuncio_id, q.tc_id, epoch_us(l.t) - epoch_us(q.fecha) AS gap FROM l ASOF JOIN tipo_cambio_bcrp q ON l.serie_tc = q.series_codigos AND l.t >= q.fecha
  UNION ALL SELECT l.anuncio_id, q.tc_id, epoch_us(q.fecha) - epoch_us(l.t) FROM l ASOF JOIN tipo_cambio_bcrp q ON l.serie_tc = q.series_codigos AND l.t <= q.fecha)
SELECT anuncio_id, arg_min(tc_id, gap) AS tc_id FROM n WHERE gap <= 43200000000 GROUP BY anuncio_id
"""


# Letters that look alike, each followed by its twin: this list is the query's own, not the operator's.
_TWINS = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv օo ɑa ɡg Ёë"
)


def _p10_sql() -> str:
    """The forms of texts with the functions that SQL has: signs dropped or translated one by one, then NFC."""
    wide = range(0xFF01, 0xFF5F)
    spaces = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
    twins = [*_TWINS.replace("Ёë", "ЁË").split(), "ёë"]
    source = "".join(t[0] for t in twins) + "".join(map(chr, [*wide, *spaces]))
    target = "".join(t[1] for t in twins) + "".join(chr(c - 0xFEE0) for c in wide) + " " * len(spaces)
    target = target.replace("'", "''")
    emoji = r"[\x{1F000}-\x{1FAFF}\x{2190}-\x{21FF}\x{2300}-\x{27BF}]"
    kept = "text"
    for _ in range(2):  # a joiner between emoji stays, also where it follows another
        kept = f"regexp_replace({kept}, '({emoji})\u200d({emoji})', '\\1\ufdd0\\2', 'g')"
    hidden = r"[\x{AD}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]"
    lines = f"regexp_replace(regexp_replace({kept}, '{hidden}', '', 'g'), '\\r\\n?', chr(10), 'g')"
    return f"""
WITH f AS (SELECT text, nfc_normalize(translate({lines}, '{source}', '{target}')) AS c FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
k AS (SELECT d.doc_id, d.text, f.c FROM documents d JOIN f USING (text) WHERE regexp_matches(c, '\\S'))
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM k a JOIN k b ON a.c = b.c AND a.doc_id < b.doc_id AND a.text <> b.text"""


QUERIES = {
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_mezcla": p9_mezcla,
    "p9_reporte": p9_reporte,
    "p9_temperatura": p9_temperatura,
    "p10_found": p10_found,
}
ORACLES = {"p4_found": P4_SQL, "p6_found": P6_SQL, "p10_found": _p10_sql()}
