"""Queries of the general problems: units, instants, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablon.functions.identity import canonical_link
from tablon.operators.instants import stated_instants
from tablon.operators.snapshots import snapshot_differences
from tablon.operators.units import amounts_in_soles
from tablon.sources.tables import table

TRACKED = ["titulo", "precio", "anunciante_id", "ausencias_consecutivas"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return amounts_in_soles(table(spark, d, "anuncios"), table(spark, d, "corridas"), table(spark, d, "tipo_cambio_bcrp"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return stated_instants(
        table(spark, d, "anuncios"), table(spark, d, "portales"), ["fecha_publicacion", "fecha_extraccion"]
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_differences(
        table(spark, d, "fotos_anuncios"), table(spark, d, "corridas"), canonical_link(F.col("enlace")), TRACKED
    )


_CANON = (
    "regexp_replace(lower(regexp_extract(trim(enlace), '^([A-Za-z][A-Za-z0-9+.-]*:)?', 1)) || "
    "regexp_replace(regexp_extract(trim(enlace), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?([^?#]*)', 1), ';[^/]*$', ''), '/+$', '')"
)

P5_SQL = f"""
WITH f AS (
  SELECT corrida_id, {_CANON} AS enlace, titulo, precio, anunciante_id, ausencias_consecutivas
  FROM fotos_anuncios WHERE enlace IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY corrida_id, {_CANON} ORDER BY recibido_en DESC) = 1),
s AS (
  SELECT corrida_id,
         lag(corrida_id) OVER w AS previa, lead(corrida_id) OVER w AS siguiente
  FROM corridas WHERE corrida_id IN (SELECT corrida_id FROM f)
  WINDOW w AS (PARTITION BY portal, tipo_operacion ORDER BY fecha, corrida_id)),
a AS (SELECT f.*, s.previa FROM f JOIN s USING (corrida_id) WHERE s.previa IS NOT NULL),
b AS (SELECT f.*, s.siguiente FROM f JOIN s USING (corrida_id) WHERE s.siguiente IS NOT NULL)
SELECT coalesce(a.corrida_id, b.siguiente) AS corrida_id, coalesce(a.enlace, b.enlace) AS enlace,
       CASE WHEN b.enlace IS NULL THEN 'alta' WHEN a.enlace IS NULL THEN 'baja' ELSE 'cambio' END AS cambio
FROM a FULL JOIN b ON a.previa = b.corrida_id AND a.enlace = b.enlace
WHERE a.enlace IS NULL OR b.enlace IS NULL
   OR (a.titulo, a.precio, a.anunciante_id, a.ausencias_consecutivas)
      IS DISTINCT FROM (b.titulo, b.precio, b.anunciante_id, b.ausencias_consecutivas)
"""



def _money(t: str) -> str:
    """The currency of a text in SQL; the order matters."""
    return (
        f"CASE WHEN regexp_matches({t}, 'clp|chilen') THEN 'CLP' WHEN regexp_matches({t}, 'r\\$|brl|\\breal(es)?\\b') THEN 'BRL' WHEN regexp_matches({t}, '\\beur|€') THEN 'EUR' "
        f"WHEN regexp_matches({t}, 'us?d? ?\\$|u\\$s|usd|dolar|\\$') THEN 'USD' WHEN regexp_matches({t}, '(^|[^a-z])s/|\\bsol(es)?\\b|\\bpen\\b') THEN 'PEN' END"
    )


def _factor(t: str) -> str:
    """The scale of a text in SQL."""
    return (
        f"CASE WHEN regexp_matches({t}, '\\b(centavos?|cents?|centimos?|cts?)\\b') THEN 0.01 WHEN regexp_matches({t}, '\\b(millon(es)?|mill|mm)\\b') THEN 1000000 "
        f"WHEN regexp_matches({t}, '\\bmil(es)?\\b|\\b1[., ]?000\\b') THEN 1000 ELSE 1 END"
    )


_WORDS = (
    "MAP {'un': 1, 'dos': 2, 'tres': 3, 'diez': 10, 'veinte': 20, 'treinta': 30, 'cuarenta': 40, 'cincuenta': 50, 'sesenta': 60, 'setenta': 70, 'ochenta': 80, 'noventa': 90, 'cien': 100, "
    "'ciento': 100, 'doscientos': 200, 'trescientos': 300, 'cuatrocientos': 400, 'quinientos': 500, 'seiscientos': 600, 'setecientos': 700, 'ochocientos': 800, 'novecientos': 900}"
)
#: Number words here are hundreds and tens of thousands, as listings have them.
P1_SQL = f"""
WITH a AS (
  SELECT anuncio_id, serie_tc, corrida_id, strip_accents(lower(coalesce(precio, ''))) AS p, strip_accents(lower(coalesce(moneda, ''))) AS m
  FROM anuncios QUALIFY row_number() OVER (PARTITION BY anuncio_id ORDER BY recibido_en) = 1),
n AS (
  SELECT *, regexp_extract(p, '[0-9]+(?:[., ''][0-9]+)*') AS t, regexp_extract(p, '[0-9]+(?:[., ''][0-9]+)*\\s*(miles|mil|millones|millon|mill|mm|m|k)(?:[^a-z0-9²]|$)', 1) AS k,
    regexp_replace(p, '[0-9]+(?:[., ''][0-9]+)*', ' ') AS rest FROM a),
g AS (SELECT *, regexp_extract_all(t, '[0-9]+') AS gs, regexp_matches(t, '[.,][0-9]+$') AND NOT regexp_matches(t, '[.,][0-9][0-9][0-9]$') AS cents FROM n),
v AS (
  SELECT *, CASE
    WHEN t <> '' THEN try_cast(CASE WHEN cents THEN array_to_string(gs[:-2], '') || '.' || gs[-1] ELSE array_to_string(gs, '') END AS decimal(18, 6)) *
      CASE WHEN k IN ('k', 'mil', 'miles') THEN 1000 WHEN k <> '' THEN 1000000 ELSE 1 END
    WHEN regexp_matches(p, '\\bmil\\b') THEN CAST(list_sum(list_transform(string_split(p, ' '), lambda w: coalesce({_WORDS}[w], 0))) * 1000 AS decimal(18, 6)) END AS monto,
    {_money("rest")} AS propia, {_money("m")} AS ajena, {_factor("m")} AS escala FROM g),
x AS (
  SELECT anuncio_id, serie_tc, corrida_id, coalesce(propia, ajena) AS divisa, CAST(monto * CASE WHEN propia IS NULL THEN escala ELSE 1 END AS decimal(20, 6)) AS monto
  FROM v WHERE monto IS NOT NULL AND coalesce(propia, ajena) IS NOT NULL),
u AS (
  SELECT series_codigos, fecha, venta, string_split(replace(regexp_replace(strip_accents(lower(coalesce(unidad, nota))), '^valores en ', ''), ' x ', ' por '), ' por ') AS s FROM tipo_cambio_bcrp),
q AS (
  SELECT series_codigos, fecha, CASE WHEN coalesce({_money("s[1]")}, 'PEN') = 'PEN' THEN CAST(CAST(venta AS decimal(18, 9)) * CAST({_factor("s[1]")} AS decimal(9, 2)) / {_factor("s[2]")} AS decimal(17, 10))
    ELSE CAST(1 / venta AS decimal(17, 10)) END AS tasa FROM u),
r AS (
  SELECT x.*, c.fecha FROM x JOIN corridas c USING (corrida_id) WHERE divisa <> 'PEN' AND serie_tc IS NOT NULL)
SELECT anuncio_id, CAST(floor(monto + 0.5) AS bigint) AS soles FROM x WHERE divisa = 'PEN'
UNION ALL
SELECT r.anuncio_id, CAST(floor(r.monto * q.tasa + 0.5) AS bigint) FROM r ASOF JOIN q ON r.serie_tc = q.series_codigos AND r.fecha >= q.fecha
"""

P2_SQL = r"""
WITH once AS (SELECT * FROM anuncios QUALIFY row_number() OVER (PARTITION BY anuncio_id ORDER BY recibido_en) = 1),
x AS (
  SELECT anuncio_id, portal, 'fecha_publicacion' AS campo, trim(regexp_replace(fecha_publicacion, '\s+', ' ', 'g')) AS raw FROM once
  UNION ALL SELECT anuncio_id, portal, 'fecha_extraccion', trim(regexp_replace(fecha_extraccion, '\s+', ' ', 'g')) FROM once),
t AS (SELECT x.*, lower(raw) AS s, zona_horaria AS z, orden_fecha AS o FROM x JOIN portales USING (portal) WHERE raw IS NOT NULL),
k AS (
  SELECT *, CASE WHEN regexp_full_match(s, '[0-9]{10}([0-9]{3})?') THEN 'e' WHEN regexp_matches(s, '^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}') THEN 'i' WHEN regexp_matches(s, '^[0-9]{8}t') THEN 'c'
    WHEN regexp_matches(s, '^[0-9]{1,2}[-/.][0-9]{1,2}[-/.]([0-9]{4}|[0-9]{2})( |$)') THEN 'n' WHEN regexp_matches(s, '^([a-z]{3}, )?[0-9]{1,2} (de )?[a-z]+\.? (de )?[0-9]{4}') THEN 't'
    WHEN regexp_matches(s, '^[a-z]+ [0-9]{1,2}, [0-9]{4}') THEN 'm' END AS forma FROM t),
g AS (
  SELECT *, CASE forma
    WHEN 'i' THEN regexp_extract(s, '^([0-9]{4})[-/]([0-9]{2})[-/]([0-9]{2})(.*)$', ['a', 'b', 'c', 'd']) WHEN 'c' THEN regexp_extract(s, '^([0-9]{4})([0-9]{2})([0-9]{2})(.*)$', ['a', 'b', 'c', 'd'])
    WHEN 'n' THEN regexp_extract(s, '^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]+)(.*)$', ['a', 'b', 'c', 'd']) WHEN 't' THEN regexp_extract(s, '^(?:[a-z]{3}, )?([0-9]{1,2}) (?:de )?([a-z]{3})[a-z]*\.? (?:de )?([0-9]{4})(.*)$', ['a', 'b', 'c', 'd'])
    WHEN 'm' THEN regexp_extract(s, '^([a-z]{3})[a-z]* ([0-9]{1,2}), ([0-9]{4})(.*)$', ['a', 'b', 'c', 'd']) END AS p FROM k WHERE forma IS NOT NULL),
d AS (
  SELECT *, CASE forma WHEN 'i' THEN p.a || '-' || p.b || '-' || p.c WHEN 'c' THEN p.a || '-' || p.b || '-' || p.c
    WHEN 'n' THEN CASE WHEN length(p.c) = 2 THEN '20' || p.c ELSE p.c END || '-' || CASE WHEN o = 'MDA' THEN p.a || '-' || p.b ELSE p.b || '-' || p.a END
    ELSE p.c || '-' || (1 + (position(substr(CASE forma WHEN 't' THEN p.b ELSE p.a END, 1, 3) IN CASE WHEN regexp_matches(s, '(jan|apr|aug|dec)') THEN 'janfebmaraprmayjunjulaugsepoctnovdec' ELSE 'enefebmarabrmayjunjulagosepoctnovdic' END) - 1) // 3)
      || '-' || CASE forma WHEN 't' THEN p.a ELSE p.b END END AS dia, coalesce(CASE WHEN forma = 'c' THEN regexp_replace(p.d, '^t([0-9]{2})([0-9]{2})([0-9]{2})', 't\1:\2:\3') ELSE p.d END, '') AS resto
  FROM (SELECT * REPLACE (regexp_replace(s, '\bset(\.| |iembre)', 'sep\1') AS s, CASE WHEN p.b = 'set' THEN struct_pack(a := p.a, b := 'sep', c := p.c, d := p.d) WHEN p.a = 'set' THEN struct_pack(a := 'sep', b := p.b, c := p.c, d := p.d) ELSE p END AS p) FROM g)),
h AS (
  SELECT *, try_cast(dia AS date) AS f, regexp_extract(resto, '([0-9]{1,2})[:.]([0-9]{2})(?:[:.]([0-9]{2}))?(?:[.,][0-9]+)?(.*)$', ['hh', 'mm', 'ss', 'cola']) AS r FROM d),
l AS (
  SELECT *, coalesce(try_cast(r.hh AS int), 0) AS hora, coalesce(r.cola, '') AS cola FROM h WHERE forma = 'e' OR f IS NOT NULL),
c AS (
  SELECT *, f + to_seconds(CASE WHEN regexp_matches(cola, '^ ?p\.? ?m') THEN hora % 12 + 12 WHEN regexp_matches(cola, '^ ?a\.? ?m\.?$') THEN hora % 12 ELSE hora END * 3600
    + coalesce(try_cast(r.mm AS int), 0) * 60 + coalesce(try_cast(nullif(r.ss, '') AS int), 0)) AS reloj,
    CASE WHEN regexp_matches(cola, '^ ?[-+][0-9]{2}:?[0-9]{2}') THEN CASE WHEN cola LIKE '%-%' AND regexp_matches(cola, '^ ?-') THEN -1 ELSE 1 END * (CAST(regexp_extract(cola, '^ ?[-+]([0-9]{2})', 1) AS int) * 3600 + CAST(regexp_extract(cola, '^ ?[-+][0-9]{2}:?([0-9]{2})', 1) AS int) * 60)
      WHEN regexp_matches(cola, 'gmt[-+][0-9]+$') THEN CAST(regexp_extract(cola, 'gmt([-+][0-9]+)$', 1) AS int) * 3600
      WHEN regexp_matches(cola, '^ ?(z|utc|gmt)$') THEN 0 WHEN cola = ' pet' THEN -18000 WHEN cola = ' clt' THEN -14400 WHEN cola = ' clst' THEN -10800 WHEN cola = ' est' THEN -18000 WHEN cola = ' edt' THEN -14400
      WHEN cola = ' cet' THEN 3600 WHEN cola = ' cest' THEN 7200 END AS desfase, coalesce(nullif(regexp_extract(raw, '([A-Z][a-z]+/[A-Za-z_]+)', 1), ''), z) AS zona FROM l),
u AS (SELECT *, timezone(zona, reloj) AS w FROM c WHERE forma <> 'e' AND desfase IS NULL)
SELECT anuncio_id, campo, CAST(substr(s, 1, 10) AS bigint) AS segundos_utc FROM c WHERE forma = 'e'
UNION ALL SELECT anuncio_id, campo, CAST(epoch(reloj) AS bigint) - desfase FROM c WHERE forma <> 'e' AND desfase IS NOT NULL
UNION ALL SELECT anuncio_id, campo, CAST(epoch(CASE WHEN timezone(zona, w - INTERVAL 1 HOUR) = reloj THEN w - INTERVAL 1 HOUR ELSE w END) AS bigint) FROM u
"""

QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p5_found": p5_found}
ORACLES = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p5_found": P5_SQL}
