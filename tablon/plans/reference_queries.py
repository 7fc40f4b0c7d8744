"""Queries of the reference's operators over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablon.functions import dates, identity, numbers, text
from tablon.operators import accumulate, diagnostics, documents, duplicates, embedded, fx, lifecycle, lookup, quality, validate
from tablon.operators.asof import asof_backward
from tablon.plans import pipeline
from tablon.session import cut_lineage, shared_folder
from tablon.sources import portal, readers
from tablon.sources.state import VersionedTable
from tablon.sources.tables import table
from tablon.streaming.runs import stream_runs, windowed_counts, written_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def canon_sql(c: str) -> str:
    return (
        f"coalesce(regexp_replace(lower(regexp_extract(trim({c}), '^([A-Za-z][A-Za-z0-9+.-]*:)?', 1)) || "
        f"regexp_replace(regexp_extract(trim({c}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?([^?#]*)', 1), ';[^/]*$', ''), '/+$', ''), '')"
    )


def listings(s: SparkSession, d: str) -> DataFrame:
    """Listings, each once: as delivered last."""
    return accumulate.keep_last(table(s, d, "anuncios"), ["anuncio_id"], [F.col("recibido_en")])


ONCE = "(SELECT * FROM anuncios QUALIFY row_number() OVER (PARTITION BY anuncio_id ORDER BY recibido_en DESC) = 1)"


@query(f"SELECT enlace, {canon_sql('enlace')} AS canonico, substr(sha1({canon_sql('enlace')}), 1, 16) AS hash FROM anuncios")
def q_canonical_link(s, d):
    e = F.col("enlace")
    return table(s, d, "anuncios").select("enlace", identity.canonical_link(e).alias("canonico"), identity.link_hash(e).alias("hash"))


@query(f"""
SELECT anuncio_id, coalesce(nullif(lower(trim(sector)), ''), 'sin_sector') || ':' || coalesce(nullif(lower(trim(portal)), ''), 'sin_portal') || ':' ||
  coalesce(nullif(lower(trim(tipo_operacion)), ''), 'sin_operacion') || ':' ||
  CASE WHEN coalesce(trim(id_portal), '') <> '' THEN 'posting:' || trim(id_portal) ELSE 'url:' || substr(sha1({canon_sql('enlace')}), 1, 16) END AS publicacion_id,
  coalesce(trim(sector), '') || '|' || coalesce(trim(portal), '') || '|tipo_operacion|' || coalesce(trim(tipo_operacion), '') || '|' || {canon_sql('enlace')} AS clave
FROM anuncios""")
def q_publication_id(s, d):
    c = F.col
    return table(s, d, "anuncios").select(
        "anuncio_id",
        identity.publication_id(c("sector"), c("portal"), c("tipo_operacion"), c("enlace"), c("id_portal")).alias("publicacion_id"),
        identity.record_key(c("sector"), c("portal"), F.lit("tipo_operacion"), c("tipo_operacion"), c("enlace")).alias("clave"),
    )


@query("""
SELECT sha256(trim(regexp_replace(lower(coalesce(titulo, '')), '\\s+', ' ', 'g'))) AS hash, count(*) AS n FROM anuncios GROUP BY 1""")
def q_content_hash(s, d):
    return table(s, d, "anuncios").groupBy(text.content_hash(F.col("titulo")).alias("hash")).agg(F.count("*").alias("n"))


_NORM = "trim(regexp_replace(strip_accents(lower(coalesce(titulo, ''))), '\\s+', ' ', 'g'))"
_DEDUP = "trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce(titulo, ''))), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_WORDS = f"list_filter(string_split({_DEDUP}, ' '), lambda w: w <> '')"


@query(f"SELECT anuncio_id, {_NORM} AS normal, {_DEDUP} AS dedup, array_to_string(list_sort({_WORDS}), ' ') AS orden, "
       f"coalesce(nullif(trim(regexp_replace(lower(titulo), '[^a-z0-9_-]+', '_', 'g'), '_'), ''), 'sin_valor') AS slug FROM anuncios")  # fmt: skip
def q_text_norm(s, d):
    t = F.col("titulo")
    return table(s, d, "anuncios").select(
        "anuncio_id", text.normal_text(t).alias("normal"), text.dedup_text(t).alias("dedup"),
        text.token_sort(text.dedup_text(t)).alias("orden"), identity.safe_slug(t).alias("slug"),
    )


@query(f"""
WITH w AS (SELECT anuncio_id, {_WORDS} AS ws FROM {ONCE}),
p AS (SELECT anuncio_id, CASE WHEN len(list_filter(ws, lambda x: length(x) >= 3)) > 0 THEN list_filter(ws, lambda x: length(x) >= 3) ELSE ws END AS pool FROM w)
SELECT anuncio_id, coalesce(list_filter(pool, lambda x: length(x) = list_max(list_transform(pool, lambda y: length(y))))[1], '') AS bloque FROM p""")
def q_blocks(s, d):
    return listings(s, d).select("anuncio_id", text.block_token(text.dedup_text(F.col("titulo"))).alias("bloque"))


@query("""
SELECT anuncio_id, try_cast(regexp_extract(replace(titulo, ',', ''), '[0-9.]+') AS double) AS numero,
  try_cast(regexp_extract(titulo, '[0-9]+') AS bigint) AS entero, try_cast(replace(CASE WHEN lower(trim(precio)) IN ('', 'n.d.', 'nd', 'nan', 'none') THEN NULL ELSE precio END, ',', '') AS double) AS tasa
FROM anuncios""")
def q_parse_numbers(s, d):
    t = F.col("titulo")
    return table(s, d, "anuncios").select(
        "anuncio_id", numbers.first_number(t).alias("numero"), numbers.first_integer(t).alias("entero"), numbers.rate_number(F.col("precio")).alias("tasa")
    )


_PHRASE = """CASE event_id % 7 WHEN 0 THEN 'Publicado hoy' WHEN 1 THEN 'publicado desde ayer' WHEN 2 THEN 'hace ' || (user_id % 20) || ' dias'
 WHEN 3 THEN 'Hace 1 semana, ' || (user_id % 6) || ' días' WHEN 4 THEN 'hace ' || (user_id % 9) || ' meses' WHEN 5 THEN (1 + user_id % 31) || ' set. 2022' ELSE 'hace 3 horas' END"""


@query(f"""
WITH f AS (SELECT event_id, {_PHRASE} AS frase, date '2026-04-22' AS hoy, user_id FROM events)
SELECT event_id, frase, CASE event_id % 7 WHEN 0 THEN hoy WHEN 1 THEN hoy - 1 WHEN 2 THEN hoy - CAST(user_id % 20 AS int) WHEN 3 THEN hoy - 7 - CAST(user_id % 6 AS int)
  WHEN 4 THEN hoy - 30 * CAST(user_id % 9 AS int) WHEN 5 THEN try_cast('2022-09-' || lpad(CAST(1 + user_id % 31 AS varchar), 2, '0') AS date) ELSE hoy END AS fecha FROM f""")
def q_relative_dates(s, d):
    rows = table(s, d, "events").select("event_id", F.expr(_PHRASE).alias("frase"))
    return rows.withColumn("fecha", dates.relative_date(F.col("frase"), F.lit("2026-04-22").cast("date")))


_DATE = r"regexp_extract(fecha_extraccion, '([0-9]{4})[-/]([0-9]{1,2})(?:[-/]([0-9]{1,2}))?', %d)"
_DAY = f"CASE WHEN {_DATE % 1} <> '' THEN try_cast({_DATE % 1} || '-' || lpad({_DATE % 2}, 2, '0') || '-' || lpad(CASE WHEN {_DATE % 3} = '' THEN '1' ELSE {_DATE % 3} END, 2, '0') AS date) END"


@query(f"""
WITH f AS (SELECT anuncio_id, {_DAY} AS dia FROM {ONCE})
SELECT anuncio_id, dia, CAST(year(dia) AS int) AS anio, lpad(CAST(year(dia) AS varchar), 4, '0') || '-T' || quarter(dia) AS trimestre, strftime(dia, '%Y-%m') AS mes,
  CAST(month(dia) AS int) AS mes_num, CAST(quarter(dia) AS int) AS trimestre_num FROM f""")
def q_periods(s, d):
    rows = dates.with_periods(listings(s, d), "fecha_extraccion", ("anio", "trimestre", "mes", "mes_num", "trimestre_num"))
    return rows.select("anuncio_id", dates.date_in_text(F.col("fecha_extraccion")).alias("dia"), "anio", "trimestre", "mes", "mes_num", "trimestre_num")


@query("""
SELECT CAST(year(o_orderdate) AS int) AS anio, year(o_orderdate) || '-T' || quarter(o_orderdate) AS trimestre, count(*) AS n,
  round(CAST(sum(CAST(o_totalprice AS decimal(18, 2))) AS double) / count(*), 2) AS media FROM orders GROUP BY ROLLUP (1, 2)""")
def q_period_rollup(s, d):
    p = dates.period(F.col("o_orderdate").cast("date"))
    rows = table(s, d, "orders").select(p["anio"].alias("anio"), p["trimestre"].alias("trimestre"), F.col("o_totalprice").cast("decimal(18,2)").alias("x"))
    return rows.rollup("anio", "trimestre").agg(F.count("*").alias("n"), F.round(F.sum("x").cast("double") / F.count("*"), 2).alias("media"))


_FIELDS = ["titulo", "precio", "moneda", "ubicacion", "no_existe"]


@query("\nUNION ALL ".join(
    f"SELECT portal, '{f}' AS campo, count(*) FILTER ({f} IS NOT NULL AND trim({f}) <> '') AS llenos, count(*) AS total, "
    f"round(count(*) FILTER ({f} IS NOT NULL AND trim({f}) <> '') / count(*), 4) AS pct, true AS presente FROM anuncios GROUP BY portal" for f in _FIELDS[:4]
) + " UNION ALL SELECT portal, 'no_existe', 0, count(*), 0.0, false FROM anuncios GROUP BY portal")
def q_coverage(s, d):
    return quality.coverage(table(s, d, "anuncios"), _FIELDS, ["portal"])


@query("""
WITH c AS (SELECT portal, count(*) AS total, avg(CASE WHEN trim(coalesce(precio, '')) <> '' THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN trim(coalesce(moneda, '')) <> '' THEN 1.0 ELSE 0.0 END) AS m,
  max(ausencias_consecutivas) > 2 AS aviso FROM anuncios GROUP BY portal)
SELECT portal, CASE WHEN p < 0.95 OR m < 0.66 THEN 'degradado' WHEN aviso THEN 'advertencia' ELSE 'ok' END AS estado, NOT (p < 0.95 OR m < 0.66) AS apta, total,
  concat_ws('; ', CASE WHEN p < 0.95 THEN 'Cobertura de ''precio'' ' || printf('%.1f', p * 100) || '% < umbral 95%' END, CASE WHEN m < 0.66 THEN 'Cobertura de ''moneda'' ' || printf('%.1f', m * 100) || '% < umbral 66%' END,
    CASE WHEN aviso THEN 'muchas ausencias' END) AS motivos FROM c""")
def q_quality_gate(s, d):
    verdict = quality.quality_gate(table(s, d, "anuncios"), {"precio": 0.95, "moneda": 0.66}, {"muchas ausencias": F.max("ausencias_consecutivas") > 2}, ["portal"])
    return verdict.withColumn("motivos", F.array_join("motivos", "; "))


@query(f"""
SELECT corrida_id, {canon_sql('enlace')} AS canonico, titulo, precio, recibido_en FROM fotos_anuncios WHERE enlace IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY corrida_id, {canon_sql('enlace')} ORDER BY recibido_en DESC) = 1""")
def q_keep_last(s, d):
    rows = table(s, d, "fotos_anuncios").where("enlace is not null").withColumn("canonico", identity.canonical_link(F.col("enlace")))
    return accumulate.keep_last(rows, ["corrida_id", "canonico"], [F.col("recibido_en")]).select("corrida_id", "canonico", "titulo", "precio", "recibido_en")


@query(f"""
SELECT portal, tipo_operacion, {canon_sql('enlace')} AS canonico, titulo, precio FROM fotos_anuncios WHERE enlace IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY portal, tipo_operacion, {canon_sql('enlace')} ORDER BY corrida_id % 2 DESC, corrida_id DESC, recibido_en DESC) = 1""")
def q_sheet_merge(s, d):
    """Even runs are the sheet as it was, odd ones are new."""
    rows = table(s, d, "fotos_anuncios").where("enlace is not null").withColumn("canonico", identity.canonical_link(F.col("enlace")))
    rows = rows.withColumn("__ord", F.struct("corrida_id", "recibido_en"))
    keys = ["portal", "tipo_operacion", "canonico"]
    columns = [*keys, "titulo", "precio"]
    old = accumulate.keep_last(rows.where("corrida_id % 2 = 0"), keys, [F.col("__ord")]).select(*columns)
    return accumulate.accumulate(old, rows.where("corrida_id % 2 = 1").select(*columns, "__ord"), keys).select(*columns)


_SCOPE = ["portal", "tipo_operacion"]
_STATE = "portal string, tipo_operacion string, enlace string, titulo string, precio double, primera_vez_visto timestamp_ntz, ultima_vez_visto timestamp_ntz, ausencias_consecutivas int, activo boolean, fecha_baja date"
_RANKED = """n AS (SELECT corrida_id, portal, tipo_operacion, fecha, row_number() OVER (PARTITION BY portal, tipo_operacion ORDER BY fecha, corrida_id) AS n
  FROM corridas WHERE corrida_id IN (SELECT corrida_id FROM fotos_anuncios))"""


def _runs(s: SparkSession, d: str) -> DataFrame:
    """Runs that delivered, numbered within their scope."""
    w = Window.partitionBy(*_SCOPE).orderBy("fecha", "corrida_id")
    there = table(s, d, "fotos_anuncios").select("corrida_id").distinct()
    return table(s, d, "corridas").join(there, "corrida_id", "left_semi").withColumn("n", F.row_number().over(w))


_RUNS_CTE = f"""
WITH RECURSIVE k AS (SELECT corrida_id, portal, tipo_operacion, fecha, coalesce(listado_completo, true) AS completa, coalesce(estado_calidad IN ('degradado', 'degradada'), false) AS mala FROM corridas
  QUALIFY id_fuente IS NULL OR row_number() OVER (PARTITION BY portal, tipo_operacion, id_fuente ORDER BY fecha, corrida_id) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY portal, tipo_operacion ORDER BY fecha, corrida_id) AS n FROM k),
f AS (SELECT n.n, n.fecha, n.portal, n.tipo_operacion, {canon_sql('f.enlace')} AS enlace, titulo, precio FROM fotos_anuncios f JOIN n USING (corrida_id) WHERE {canon_sql('f.enlace')} <> ''
  QUALIFY row_number() OVER (PARTITION BY corrida_id, {canon_sql('f.enlace')} ORDER BY recibido_en DESC) = 1),
r AS (SELECT CAST(0 AS bigint) AS n, CAST(NULL AS varchar) AS portal, CAST(NULL AS varchar) AS tipo_operacion, CAST(NULL AS varchar) AS enlace, CAST(NULL AS varchar) AS titulo, CAST(NULL AS double) AS precio,
    CAST(NULL AS timestamp) AS primera, CAST(NULL AS timestamp) AS ultima, 0 AS ausencias, false AS activo, CAST(NULL AS date) AS baja, CAST(NULL AS varchar) AS estado, false AS falta
  UNION ALL
  SELECT n, portal, tipo_operacion, enlace, titulo, precio, primera, ultima, CASE WHEN falta THEN ausencias + 1 ELSE ausencias END, activo AND NOT (falta AND ausencias + 1 >= 3),
    CASE WHEN falta AND ausencias + 1 >= 3 THEN CAST(fecha AS date) ELSE baja END, estado, falta
  FROM (SELECT *, coalesce(cuenta AND activo AND NOT vista AND NOT (base >= 20 AND presentes < 0.4 * base), false) AS falta
    FROM (SELECT m.*, c.fecha, c.completa AND NOT c.mala AS cuenta, CASE WHEN c.n IS NULL THEN antes ELSE ahora END AS estado,
        count(*) FILTER (activo) OVER (PARTITION BY m.portal, m.tipo_operacion) AS base, count(*) FILTER (activo AND vista) OVER (PARTITION BY m.portal, m.tipo_operacion) AS presentes
      FROM (SELECT (SELECT max(n) + 1 FROM r) AS n, coalesce(a.portal, b.portal) AS portal, coalesce(a.tipo_operacion, b.tipo_operacion) AS tipo_operacion, coalesce(a.enlace, b.enlace) AS enlace,
          b.n IS NOT NULL AS vista, CASE WHEN b.n IS NULL THEN a.titulo ELSE b.titulo END AS titulo, CASE WHEN b.n IS NULL THEN a.precio ELSE b.precio END AS precio,
          coalesce(a.primera, b.fecha) AS primera, coalesce(b.fecha, a.ultima) AS ultima, CASE WHEN b.n IS NULL THEN a.ausencias ELSE 0 END AS ausencias, b.n IS NOT NULL OR a.activo AS activo,
          CASE WHEN b.n IS NULL THEN a.baja END AS baja, a.estado AS antes, CASE WHEN b.n IS NOT NULL AND a.n IS NOT NULL THEN 'repetido' WHEN b.n IS NOT NULL THEN 'nuevo' END AS ahora
        FROM r a FULL JOIN (SELECT * FROM f WHERE n = (SELECT max(n) + 1 FROM r)) b ON a.portal = b.portal AND a.tipo_operacion = b.tipo_operacion AND a.enlace = b.enlace
      ) m LEFT JOIN n c ON c.portal = m.portal AND c.tipo_operacion = m.tipo_operacion AND c.n = m.n))
  WHERE n <= (SELECT max(n) FROM n))"""
_RUNS_SQL = _RUNS_CTE + """
SELECT portal, tipo_operacion, enlace, titulo, precio, primera AS primera_vez_visto, ultima AS ultima_vez_visto, ausencias AS ausencias_consecutivas, activo, baja AS fecha_baja, estado AS estado_anuncio
FROM r WHERE enlace IS NOT NULL AND n = (SELECT max(n) FROM n)"""


def _history(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All snapshots' rows, their runs, and an empty state. A source id that a scope has had is no run again; an
    unstated listado_completo is true, the reference's default."""
    first = lifecycle.known_source_ids(table(s, d, "corridas"), _SCOPE).where("not ya_registrada")
    runs = first.select("corrida_id", *_SCOPE, F.col("fecha").alias("at"), F.coalesce("listado_completo", F.lit(True)).alias("complete"), F.col("estado_calidad").alias("quality"), F.lit(False).alias("rerun"))
    rows = table(s, d, "fotos_anuncios").select("corrida_id", *_SCOPE, "enlace", "titulo", "precio", "recibido_en")
    return rows, runs, s.createDataFrame([], _STATE)


@query(_RUNS_SQL)
def q_lifecycle_runs(s, d):
    """All runs of every scope, one after another: the state at the end."""
    return lifecycle.fold_runs(*_history(s, d), lifecycle.Policy(), _SCOPE, "recibido_en")


@query(_RUNS_CTE + """
SELECT n.corrida_id, count(r.estado) AS n_total, count(*) FILTER (r.estado = 'nuevo') AS n_nuevos, count(*) FILTER (r.estado = 'repetido') AS n_repetidos, count(*) FILTER (r.falta) AS n_desaparecidos
FROM n LEFT JOIN r ON r.n = n.n AND r.portal = n.portal AND r.tipo_operacion = n.tipo_operacion GROUP BY n.corrida_id""")
def q_lifecycle_log(s, d):
    """The log that all runs of every scope write."""
    return lifecycle.fold_log(*_history(s, d), lifecycle.Policy(), _SCOPE, "recibido_en")


@query(_RUNS_SQL)
def q_stream_runs(s, d):
    """The same runs as a stream of snapshot rows that is read to its end, into a versioned table."""
    rows, runs, empty = _history(s, d)
    folder = shared_folder(s, "corridas")
    source = s.readStream.schema(table(s, d, "fotos_anuncios").schema).parquet(f"{d}/fotos_anuncio[s].parquet")
    state = VersionedTable(s, f"{folder}/estado", empty.schema)
    stream_runs(source, state, f"{folder}/avance", _SCOPE, "corrida_id", "recibido_en", lifecycle.Policy(), rows.columns, "recibido_en", runs.drop("rerun")).awaitTermination()
    return state.read().drop("ultima_corrida")


@query(f"""
WITH {_RANKED}, f AS (SELECT DISTINCT n.n, n.portal, n.tipo_operacion, {canon_sql('f.enlace')} AS enlace FROM fotos_anuncios f JOIN n USING (corrida_id) WHERE n.n <= 2 AND {canon_sql('f.enlace')} <> ''),
m AS (SELECT coalesce(a.portal, b.portal) AS portal, coalesce(a.tipo_operacion, b.tipo_operacion) AS tipo_operacion, a.n IS NOT NULL AS was, b.n IS NOT NULL AS seen
  FROM (SELECT * FROM f WHERE n = 1) a FULL JOIN (SELECT * FROM f WHERE n = 2) b ON a.portal = b.portal AND a.tipo_operacion = b.tipo_operacion AND a.enlace = b.enlace),
g AS (SELECT count(*) FILTER (seen) AS total, count(*) FILTER (seen AND NOT was) AS nuevos, count(*) FILTER (seen AND was) AS repetidos, count(*) FILTER (NOT seen) AS faltan,
  count(*) >= 20 AND count(*) FILTER (seen) < 0.4 * count(*) AS cae, count(*) FILTER (seen) = 0 AS nada FROM m GROUP BY portal, tipo_operacion)
SELECT CAST(sum(total) AS bigint) AS total, CAST(sum(nuevos) AS bigint) AS nuevos, CAST(sum(repetidos) AS bigint) AS repetidos, CAST(coalesce(sum(faltan) FILTER (NOT cae), 0) AS bigint) AS desaparecidos,
  CAST(coalesce(sum(faltan) FILTER (NOT cae), 0) AS bigint) AS dados_de_baja, CAST((SELECT count(*) FROM fotos_anuncios JOIN n USING (corrida_id) WHERE n.n = 2) - sum(total) AS bigint) AS duplicados_descartados,
  false AS omitido_por_rerun, true AS mutacion_desaparecidos, true AS listado_completo, bool_or(cae) AS colapso_listado, 'fuente' AS id_fuente FROM g""")
def q_run_statistics(s, d):
    """What a run over every scope that retires at the first absence says of itself; its base is what the scopes had before."""
    policy, empty = lifecycle.Policy(absences=1), s.createDataFrame([], _STATE)
    runs = _runs(s, d)
    rows = table(s, d, "fotos_anuncios").select("corrida_id", *_SCOPE, "enlace", "titulo", "precio", "recibido_en")
    one, two = (rows.join(runs.where(F.col("n") == n).select("corrida_id"), "corrida_id").drop("corrida_id") for n in (1, 2))
    scopes = [r.asDict() for r in runs.select(*_SCOPE).distinct().collect()]  # the run's scopes, as a caller states them
    before = cut_lineage(lifecycle.apply_run(empty, one, lifecycle.Run(datetime(2026, 1, 1)), policy, _SCOPE, "recibido_en", scopes)).drop("estado_anuncio")
    run = lifecycle.Run(datetime(2026, 1, 2))
    after = cut_lineage(lifecycle.apply_run(before, two, run, policy, _SCOPE, "recibido_en", scopes))
    return lifecycle.run_statistics(before, after, _SCOPE, run, policy, two.count(), "fuente")


@query(f"""
WITH f AS (SELECT portal, tipo_operacion, {canon_sql('enlace')} AS enlace FROM fotos_anuncios WHERE {canon_sql('enlace')} <> '' GROUP BY ALL), g AS (SELECT portal, tipo_operacion, count(*) AS k FROM f GROUP BY ALL)
SELECT portal, tipo_operacion, enlace, CASE WHEN k < 20 THEN 1 ELSE 0 END AS ausencias_consecutivas, k >= 20 AS activo, CASE WHEN k < 20 THEN date '2026-01-02' END AS fecha_baja FROM f JOIN g USING (portal, tipo_operacion)""")
def q_empty_run(s, d):
    """A complete run that finds nothing, over a state of all listings: small scopes lose all, the guard holds for others."""
    policy, empty = lifecycle.Policy(absences=1), s.createDataFrame([], _STATE)
    rows = table(s, d, "fotos_anuncios").select(*_SCOPE, "enlace", "titulo", "precio", "recibido_en")
    scopes = [r.asDict() for r in rows.select(*_SCOPE).distinct().collect()]  # the run's scopes, as a caller states them
    state = lifecycle.apply_run(empty, rows, lifecycle.Run(datetime(2026, 1, 1)), policy, _SCOPE, "recibido_en").drop("estado_anuncio")
    after = lifecycle.apply_run(state, rows.where("false"), lifecycle.Run(datetime(2026, 1, 2)), policy, _SCOPE, "recibido_en", scopes)
    return after.select(*_SCOPE, "enlace", "ausencias_consecutivas", "activo", "fecha_baja")


@query(f"""
WITH {_RANKED}, t AS (SELECT portal, tipo_operacion, max(n) AS total FROM n GROUP BY ALL),
x AS (SELECT n.portal, n.tipo_operacion, {canon_sql('f.enlace')} AS enlace, min(n.fecha) AS primera, max(n.fecha) AS ultima, max(n.n) AS last
  FROM fotos_anuncios f JOIN n USING (corrida_id) WHERE f.enlace IS NOT NULL GROUP BY ALL)
SELECT portal, tipo_operacion, enlace, primera, ultima, CAST(least(3, total - last) AS int) AS ausencias, least(3, total - last) < 3 AS activo FROM x JOIN t USING (portal, tipo_operacion)""")
def q_lifecycle_closed_form(s, d):
    runs = _runs(s, d).select("corrida_id", *_SCOPE, "fecha")
    return lifecycle.closed_form(table(s, d, "fotos_anuncios"), runs, _SCOPE, 3)


@query(f"""
SELECT portal, tipo_operacion, {canon_sql('enlace')} AS canonico FROM anuncios WHERE activo AND enlace IS NOT NULL AND ultima_vez_visto < (SELECT max(fecha) FROM corridas) - INTERVAL 30 DAY GROUP BY ALL""")
def q_staleness(s, d):
    """Active listings unseen for thirty days before the last run."""
    last = table(s, d, "corridas").agg(F.max("fecha").alias("last"))
    rows = table(s, d, "anuncios").where("enlace is not null").crossJoin(F.broadcast(last))  # one row
    return lifecycle.stale_listings(rows, F.col("last"), 30).select(*_SCOPE, identity.canonical_link(F.col("enlace")).alias("canonico")).distinct()


@query(f"""
WITH {_RANKED}, f AS (SELECT DISTINCT corrida_id, {canon_sql('enlace')} AS enlace FROM fotos_anuncios WHERE enlace IS NOT NULL),
p AS (SELECT n.portal, n.tipo_operacion, f.enlace, min(n.n) AS primera FROM f JOIN n USING (corrida_id) GROUP BY ALL)
SELECT f.corrida_id, count(*) AS n_total, count(*) FILTER (p.primera = n.n) AS n_nuevos, count(*) FILTER (p.primera < n.n) AS n_repetidos
FROM f JOIN n USING (corrida_id) JOIN p ON p.portal = n.portal AND p.tipo_operacion = n.tipo_operacion AND p.enlace = f.enlace GROUP BY 1""")
def q_run_log(s, d):
    return lifecycle.first_seen_counts(table(s, d, "fotos_anuncios"), _runs(s, d), _SCOPE)


@query("""
SELECT corrida_id, id_fuente, id_fuente IS NOT NULL AND row_number() OVER (PARTITION BY portal, tipo_operacion, id_fuente ORDER BY fecha, corrida_id) > 1 AS ya_registrada FROM corridas""")
def q_rerun_check(s, d):
    """Runs whose source id their scope has had before."""
    return lifecycle.known_source_ids(table(s, d, "corridas"), _SCOPE).select("corrida_id", "id_fuente", "ya_registrada")


@query(f"""
SELECT DISTINCT {canon_sql('enlace')} AS canonico FROM anuncios WHERE {canon_sql('enlace')} NOT IN
  (SELECT {canon_sql('enlace_a')} FROM pares_duplicados UNION SELECT {canon_sql('enlace_b')} FROM pares_duplicados)""")
def q_new_refs(s, d):
    """Listings whose link no pair holds."""
    pairs = table(s, d, "pares_duplicados")
    known = pairs.select(identity.canonical_link(F.col("enlace_a")).alias("enlace_canon")).unionAll(pairs.select(identity.canonical_link(F.col("enlace_b"))))
    found = table(s, d, "anuncios").select(identity.canonical_link(F.col("enlace")).alias("enlace_canon")).distinct()
    return portal.new_references(found, known).select(F.col("enlace_canon").alias("canonico"))


@query(f"""
SELECT a.anuncio_id, t.tc_id, t.venta FROM (SELECT * FROM {ONCE} WHERE serie_tc IS NOT NULL) a ASOF LEFT JOIN tipo_cambio_bcrp t
  ON a.serie_tc = t.series_codigos AND a.ultima_vez_visto >= t.fecha
UNION ALL SELECT anuncio_id, NULL, NULL FROM {ONCE} WHERE serie_tc IS NULL""")
def q_fx_asof(s, d):
    rows = listings(s, d).select("anuncio_id", "serie_tc", "ultima_vez_visto")
    found = asof_backward(rows, table(s, d, "tipo_cambio_bcrp"), {"serie_tc": "series_codigos"}, ("ultima_vez_visto", "fecha"), {"tc_id": "tc_id", "venta": "venta"})
    return found.select("anuncio_id", "tc_id", "venta")


@query("""
WITH o AS (SELECT o_orderkey, o_orderdate, [0, 7, 11, 13][1 + o_custkey % 4] AS m2, CASE WHEN o_orderkey % 3 <> 1 THEN floor(o_totalprice) END AS s, CASE WHEN o_orderkey % 3 <> 2 THEN floor(o_totalprice / 4) END AS u FROM orders),
r AS (SELECT orderday AS fecha, 3.0 + (row_number() OVER (ORDER BY orderday) % 64) / 71.3 AS venta FROM (SELECT DISTINCT date_trunc('week', o_orderdate) AS orderday FROM orders)),
e AS (SELECT o.*, r.fecha, r.venta, CASE WHEN s IS NULL AND u IS NOT NULL THEN round_even(u * r.venta, 2) END AS es, CASE WHEN u IS NULL AND s IS NOT NULL THEN round_even(s / r.venta, 2) END AS eu FROM o ASOF LEFT JOIN r ON o.o_orderdate >= r.fecha)
SELECT o_orderkey, s AS monto_s, u AS monto_u, venta AS tc, fecha AS tc_fecha, CASE WHEN venta IS NOT NULL THEN 'venta' END AS tc_modo, es AS soles_estimado, eu AS dolares_estimado,
  concat_ws(',', CASE WHEN es IS NOT NULL THEN 'monto_s' END, CASE WHEN eu IS NOT NULL THEN 'monto_u' END) AS imputado,
  CASE WHEN m2 > 0 THEN round_even(coalesce(s, es) / m2, 2) END AS soles_por_m2, CASE WHEN m2 > 0 THEN round_even(coalesce(u, eu) / m2, 2) END AS dolares_por_m2 FROM e""")
def q_fx_convert(s, d):
    orders = table(s, d, "orders")
    rows = orders.select(
        "o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 3 != 1, F.floor(F.col("o_totalprice")).cast("double")).alias("monto_s"),
        F.when(F.col("o_orderkey") % 3 != 2, F.floor(F.col("o_totalprice") / 4).cast("double")).alias("monto_u"), F.get(F.array(*[F.lit(x) for x in (0, 7, 11, 13)]), (F.col("o_custkey") % 4).cast("int")).alias("m2"),
    )
    weeks = orders.select(F.date_trunc("week", "o_orderdate").cast("timestamp_ntz").alias("fecha")).distinct()
    n = F.row_number().over(Window.orderBy("fecha"))  # one row a week
    rates = weeks.select("fecha", (F.lit(3.0) + (n % 64) / 71.3).alias("venta")).withColumn("compra", F.col("venta"))
    return fx.convert_amounts(rows, rates, "o_orderdate", "monto_s", "monto_u", "m2").drop("o_orderdate", "m2").withColumn("imputado", F.array_join("imputado", ","))


_CACHE = """c AS (SELECT CAST(fecha AS date) AS fecha, compra, venta FROM tipo_cambio_bcrp WHERE series_codigos = 'PXU-4101' QUALIFY row_number() OVER (PARTITION BY CAST(fecha AS date) ORDER BY fecha DESC) = 1),
g AS (SELECT CAST(fecha AS date) AS fecha, compra, venta FROM tipo_cambio_bcrp WHERE series_codigos = 'PXU-4102' QUALIFY row_number() OVER (PARTITION BY CAST(fecha AS date) ORDER BY fecha DESC) = 1)"""
_CACHED = "fecha date, compra double, venta double, promedio double, fuente string, series_codigos string, descargado_en timestamp_ntz"
_AT = "2026-01-01 00:00:00"


def _rate_cache(s: SparkSession, d: str, series: str) -> DataFrame:
    """A series as the cache has it."""
    quotes = table(s, d, "tipo_cambio_bcrp").where(F.col("series_codigos") == series).select("fecha", "compra", "venta")
    return fx.cached_rates(s.createDataFrame([], _CACHED), quotes, series, "servicio", F.lit(_AT).cast("timestamp_ntz"))


@query(f"""
WITH {_CACHE} SELECT coalesce(g.fecha, c.fecha) AS fecha, CASE WHEN g.fecha IS NULL THEN c.compra ELSE g.compra END AS compra, CASE WHEN g.fecha IS NULL THEN c.venta ELSE g.venta END AS venta,
  CASE WHEN g.fecha IS NULL THEN 'PXU-4101' ELSE 'PXU-4102' END AS series_codigos, 'servicio' AS fuente FROM c FULL JOIN g ON c.fecha = g.fecha""")
def q_fx_cache(s, d):
    """A cache of one series over which another one is saved."""
    quotes = table(s, d, "tipo_cambio_bcrp").where("series_codigos = 'PXU-4102'").select("fecha", "compra", "venta")
    both = fx.cached_rates(_rate_cache(s, d, "PXU-4101"), quotes, "PXU-4102", "servicio", F.lit(_AT).cast("timestamp_ntz"))
    return both.select("fecha", "compra", "venta", "series_codigos", "fuente")


@query("""
WITH w AS (SELECT DISTINCT serie_tc, CAST(ultima_vez_visto AS date) AS dia FROM anuncios WHERE serie_tc IS NOT NULL AND ultima_vez_visto IS NOT NULL),
f AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM tipo_cambio_bcrp t WHERE t.series_codigos = w.serie_tc AND CAST(t.fecha AS date) = w.dia))
SELECT serie_tc, min(dia) - 10 AS desde, max(dia) AS hasta, count(*) AS dias FROM f GROUP BY serie_tc""")
def q_fx_missing_range(s, d):
    """Days to ask a service for, of every series, for the days on which listings were last seen."""
    return fx.missing_range(table(s, d, "anuncios"), table(s, d, "tipo_cambio_bcrp"), "ultima_vez_visto", 10, {"serie_tc": "series_codigos"})


@query(f"""
WITH {_CACHE}, w AS (SELECT DISTINCT CAST(ultima_vez_visto AS date) AS dia FROM anuncios WHERE ultima_vez_visto IS NOT NULL),
f AS (SELECT min(dia) - 10 AS a, max(dia) AS z FROM w WHERE dia NOT IN (SELECT fecha FROM c)),
t AS (SELECT fecha, compra, venta FROM g, f WHERE fecha BETWEEN a AND z UNION ALL SELECT fecha, compra, venta FROM c, f WHERE fecha NOT IN (SELECT fecha FROM g WHERE g.fecha BETWEEN a AND z))
SELECT w.dia, t.fecha AS tc_fecha, t.venta FROM w ASOF LEFT JOIN t ON w.dia >= t.fecha""")
def q_fx_by_day(s, d):
    """The rate of each day on which listings were last seen, from a cache and a service that has another series."""
    def service(first, last):
        day = F.to_date("fecha")
        return table(s, d, "tipo_cambio_bcrp").where("series_codigos = 'PXU-4102'").where(day.between(F.lit(first), F.lit(last))).select("fecha", "compra", "venta")

    found, _ = fx.rates_by_day(table(s, d, "anuncios"), "ultima_vez_visto", _rate_cache(s, d, "PXU-4101"), service, "PXU-4102", "servicio", F.lit(_AT).cast("timestamp_ntz"))
    return found.select("dia", "tc_fecha", "venta")


@query("SELECT tc_id, fecha, venta FROM tipo_cambio_bcrp WHERE CAST(fecha AS date) BETWEEN date '2024-01-01' AND date '2024-06-30'")
def q_fx_history(s, d):
    return fx.rate_history(table(s, d, "tipo_cambio_bcrp"), "2024-01-01", "2024-06-30").select("tc_id", "fecha", "venta")


@query("SELECT DISTINCT CAST(ultima_vez_visto AS date) AS dia FROM anuncios WHERE ultima_vez_visto IS NOT NULL AND CAST(ultima_vez_visto AS date) NOT IN (SELECT CAST(fecha AS date) FROM tipo_cambio_bcrp)")
def q_fx_missing_days(s, d):
    return fx.missing_days(table(s, d, "anuncios"), table(s, d, "tipo_cambio_bcrp"), "ultima_vez_visto")


_PLACE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(trim(coalesce(%s, '')))), '[^\w\s./,;|-]', ' ', 'g'), '\b(en|de|del|la|el|los|las)\s+(venta|alquiler)\b', ' ', 'g'), '\s+', ' ', 'g'), '^[ .,;|/-]+|[ .,;|/-]+$', '', 'g')"


@query(f"""
WITH e AS (SELECT lugar_id, {_PLACE % 'distrito'} AS distrito, trim(regexp_replace({_PLACE % 'nse'}, '[\\s-]+', ' ', 'g')) AS nse FROM lugares_nse),
v AS (SELECT lugar_id, distrito, CASE nse WHEN 'alto' THEN 'Alto' WHEN 'allto' THEN 'Alto' WHEN 'medio alto' THEN 'Medio Alto' WHEN 'media alto' THEN 'Medio Alto' WHEN 'medio' THEN 'Medio'
  WHEN 'medio bajo' THEN 'Medio Bajo' WHEN 'bajo' THEN 'Bajo' END AS nse FROM e),
p AS (SELECT distrito, nse, count(*) AS n, min(lugar_id) AS o FROM v WHERE nse IS NOT NULL AND distrito <> '' GROUP BY ALL)
SELECT distrito, arg_max(nse, (n, -o)) AS nse, CAST(sum(n) AS bigint) AS n FROM p GROUP BY distrito""")
def q_lookup_mode(s, d):
    """The commonest label of every district; of equals the one that comes first."""
    rows = table(s, d, "lugares_nse").select(lookup.place_text(F.col("distrito")).alias("distrito"), lookup.label(F.col("nse")).alias("nse"), F.col("lugar_id").alias("orden")).where("distrito <> '' and nse is not null")
    return lookup.commonest(rows, ["distrito"], "nse", "orden").select("distrito", "nse", "n")


def _area(s: SparkSession, d: str) -> lookup.LookupConfig:
    """The area's districts and their aliases: the fixed lists, read as parameters."""
    plain = lambda c: lookup.place_text(F.col(c))
    names = {r["distrito_id"]: r["n"] for r in table(s, d, "distritos").select("distrito_id", plain("nombre").alias("n")).collect()}
    aliases = table(s, d, "distritos_alias").select(plain("alias_texto").alias("a"), "distrito_id").collect()
    return lookup.LookupConfig(tuple(names.values()), {r["a"]: names[r["distrito_id"]] for r in aliases if r["distrito_id"] in names})


@query("""
WITH p AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS w, p_retailprice AS v FROM part),
j AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.w AS wa, b.w AS wb, a.v AS va, b.v AS vb FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1)
SELECT a, b, CAST(len(list_intersect(wa, wb)) AS double) / least(len(wa), len(wb)) AS contencion, va > 0 AND vb > 0 AND abs(va - vb) <= 0.05 * greatest(va, vb) AS coincide FROM j""")
def q_token_containment(s, d):
    p = table(s, d, "part").select("p_partkey", F.lower("p_name").alias("w"), F.col("p_retailprice").alias("v"))
    a, b = p.toDF("a", "wa", "va"), p.toDF("b", "wb", "vb")
    j = a.join(b, F.col("b") == F.col("a") + 1)
    return j.select("a", "b", text.token_containment(F.col("wa"), F.col("wb")).alias("contencion"), text.values_match(F.col("va"), F.col("vb"), 0.05).alias("coincide"))


@query("""
WITH RECURSIVE p AS (SELECT p_partkey AS id, list_distinct(list_sort(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g')), ' '))) AS w, p_brand, p_type, p_retailprice AS v FROM part),
j AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.id < b.id
  WHERE a.w = b.w OR (a.v > 0 AND b.v > 0 AND abs(a.v - b.v) <= 0.05 * greatest(a.v, b.v) AND len(list_intersect(a.w, b.w)) >= 0.6 * least(len(a.w), len(b.w)))),
e AS (SELECT a, b FROM j UNION SELECT b, a FROM j), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS id, least(a, min(b)) AS raiz FROM r GROUP BY a)
SELECT id, dense_rank() OVER (ORDER BY raiz) AS dup_grupo, count(*) OVER (PARTITION BY raiz) AS miembros FROM c""")
def q_dup_groups(s, d):
    """Parts of one brand and type whose names share words and whose prices match."""
    return duplicates.similar_groups(table(s, d, "part"), "p_partkey", "p_brand", "p_name", "p_type", "p_retailprice", python=False)


@query()
def q_dup_signal_groups(s, d):
    """Groups of parts by the full signal: like brands, and like names or matching prices and shared words."""
    return duplicates.similar_groups(table(s, d, "part"), "p_partkey", "p_brand", "p_name", "p_type", "p_retailprice")


@query()
def q_similarity(s, d):
    """Parts of one type with like brands, whose names have a like sequence of letters or whose prices
    match and names share words: every two parts."""
    return duplicates.similar_pairs(table(s, d, "part"), "p_partkey", "p_brand", "p_name", "p_type", "p_retailprice")


_HTML = """'<html><script id="__NEXT_DATA__" type="application/json">{"a": {"props": ' || props || ', "tipo": "' || event_type || '"}}</script></html>'"""


@query("SELECT event_id, event_type AS tipo, json_extract_string(props, '$.k') AS k FROM events")
def q_embedded_json(s, d):
    html = table(s, d, "events").select("event_id", F.expr(_HTML).alias("html"))
    state = html.select("event_id", embedded.page_state(F.col("html")).alias("s"))
    return state.select("event_id", embedded.state_value(F.col("s"), "$.a.tipo").alias("tipo"), embedded.state_value(F.col("s"), "$.a.props.k").alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q_find_key(s, d):
    html = table(s, d, "events").select("event_id", F.expr(_HTML).alias("html"))
    return html.select("event_id", embedded.find_key("k")(embedded.page_state(F.col("html"))).alias("k"))


@query("""
WITH h AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 403 WHEN 1 THEN 503 WHEN 2 THEN 200 WHEN 3 THEN 429 ELSE 200 END AS status, CASE WHEN event_id % 3 = 0 THEN '<p>Just a Moment</p>' ELSE '<p>ok</p>' END AS html FROM events)
SELECT event_id, CASE WHEN status IN (403, 429) THEN 'HTTP ' || status WHEN status = 503 AND html ILIKE '%just a moment%' THEN 'HTTP 503, desafío' WHEN html ILIKE '%just a moment%' THEN 'desafío' END AS motivo FROM h""")
def q_antibot(s, d):
    rows = table(s, d, "events").select(
        "event_id", F.expr("CASE event_id % 5 WHEN 0 THEN 403 WHEN 1 THEN 503 WHEN 2 THEN 200 WHEN 3 THEN 429 ELSE 200 END").alias("status"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN '<p>Just a Moment</p>' ELSE '<p>ok</p>' END").alias("html"),
    )
    return rows.select("event_id", embedded.block_reason(F.col("status"), F.col("html")).alias("motivo"))


def _boxes(s: SparkSession, d: str) -> DataFrame:
    """Order lines as word boxes: a page for each order."""
    n = F.col("l_linenumber")
    x0 = (n % 3 * 60 + F.col("l_partkey") % 7).cast("double")
    y0 = (F.floor(n / 3) * 14).cast("double")
    word = F.concat(F.col("l_returnflag"), n.cast("string"))
    return table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("pagina"), x0.alias("x0"), (x0 + 20 + F.col("l_suppkey") % 9).alias("x1"), y0.alias("y0"), (y0 + 10).alias("y1"),
        word.alias("texto"), (n % 4 == 3).cast("int").alias("tipo"),
    )


_BOXES = """(SELECT l_orderkey AS pagina, CAST(l_linenumber % 3 * 60 + l_partkey % 7 AS double) AS x0, CAST(l_linenumber % 3 * 60 + l_partkey % 7 + 20 + l_suppkey % 9 AS double) AS x1,
  CAST(floor(l_linenumber / 3) * 14 AS double) AS y0, l_returnflag || l_linenumber AS texto, CAST(l_linenumber % 4 = 3 AS int) AS tipo FROM lineitem)"""
_CUTS = f"""m AS (SELECT pagina, min(x0) AS a FROM {_BOXES} GROUP BY 1), c AS (SELECT w.pagina, a, floor(x0 - a) AS i0, floor(x1 - a) AS i1 FROM {_BOXES} w JOIN m USING (pagina)),
o AS (SELECT *, max(i1) OVER (PARTITION BY pagina ORDER BY i0, i1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM c),
k AS (SELECT pagina, a + (p + 1 + i0) / 2.0 AS corte FROM o WHERE i0 - p - 1 >= 10)"""


@query(f"SELECT pagina, string_agg(texto, '\n' ORDER BY round_even(x0 / 50.0, 0), y0, x0, texto) AS texto FROM {_BOXES} WHERE tipo = 0 GROUP BY pagina")
def q_block_order(s, d):
    return documents.ordered_text(_boxes(s, d), ["pagina"])


@query(f"WITH {_CUTS} SELECT pagina, corte FROM k")
def q_table_cuts(s, d):
    return documents.column_cuts(_boxes(s, d), ["pagina"])


@query(f"""
WITH {_CUTS}, w AS (SELECT b.*, CAST(dense_rank() OVER (PARTITION BY pagina ORDER BY y0) - 1 AS int) AS fila, (SELECT count(*) FROM k WHERE k.pagina = b.pagina AND (b.x0 + b.x1) / 2 > corte) AS col FROM {_BOXES} b),
t AS (SELECT pagina, fila, col, string_agg(texto, ' ' ORDER BY x0, texto) AS celda FROM w GROUP BY ALL)
SELECT pagina, fila, string_agg(col || '=' || celda, '|' ORDER BY col) AS celdas FROM t GROUP BY ALL""")
def q_table_cells(s, d):
    boxes = _boxes(s, d)
    cells = documents.table_cells(documents.text_rows(boxes, ["pagina"]), documents.column_cuts(boxes, ["pagina"]), ["pagina"])
    named = F.array_join(F.filter(F.transform("celdas", lambda c, i: F.when(c != "", F.concat(i.cast("string"), F.lit("="), c))), lambda c: c.isNotNull()), "|")
    return cells.select("pagina", "fila", named.alias("celdas"))


@query("""
WITH t AS (SELECT anuncio_id, trim(coalesce(titulo, '')) AS a, trim(coalesce(ubicacion, '')) AS b FROM """ + ONCE + """)
SELECT anuncio_id, 0 AS orden, 'A-1' AS codigo, 'A' AS seccion, a AS aviso FROM t WHERE a <> '' UNION ALL SELECT anuncio_id, 1, 'B-2', 'B', b FROM t WHERE b <> ''""")
def q_segments(s, d):
    """Two notices of each listing in one text, each before its code."""
    page = F.concat(F.coalesce("titulo", F.lit("")), F.lit(" ##A-1## "), F.coalesce("ubicacion", F.lit("")), F.lit(" ##B-2##"))
    rows = listings(s, d).select("anuncio_id", page.alias("texto"))
    return documents.notices(rows, "texto", r"##([A-Z]-[0-9]+)##", r"^([A-Z])-").select("anuncio_id", "orden", "codigo", "seccion", "aviso")


@query(f"""
WITH c AS (SELECT anunciante_id, sha256(trim(regexp_replace(lower(coalesce(titulo, '')), '\\s+', ' ', 'g'))) AS h, max(moneda) AS v FROM anuncios WHERE trim(moneda) <> '' GROUP BY ALL)
SELECT a.anuncio_id, CASE WHEN trim(coalesce(a.moneda, '')) = '' THEN coalesce(c.v, a.moneda) ELSE a.moneda END AS moneda FROM {ONCE} a
LEFT JOIN c ON c.anunciante_id = a.anunciante_id AND c.h = sha256(trim(regexp_replace(lower(coalesce(a.titulo, '')), '\\s+', ' ', 'g')))""")
def q_cache_fill(s, d):
    """Blank currencies from other listings of the same advertiser and title."""
    keys = ["anunciante_id", "h"]
    rows = listings(s, d).withColumn("h", text.content_hash(F.col("titulo")))
    cache = table(s, d, "anuncios").where(F.trim("moneda") != "").select("anunciante_id", text.content_hash(F.col("titulo")).alias("h"), F.col("moneda").alias("valor"))
    return accumulate.fill_blank(rows, cache, keys, "valor", "moneda").select("anuncio_id", "moneda")


@query(f"""
SELECT anuncio_id FROM {ONCE} a WHERE trim(coalesce(moneda, '')) = '' AND NOT EXISTS
  (SELECT 1 FROM anuncios c WHERE c.anunciante_id = a.anunciante_id AND c.portal = a.portal AND trim(c.moneda) <> '')""")
def q_pending(s, d):
    cache = table(s, d, "anuncios").where(F.trim("moneda") != "")
    return accumulate.pending(listings(s, d), cache, ["anunciante_id", "portal"], "moneda").select("anuncio_id")


@query("""
WITH p AS (SELECT corrida_id, portal, tipo_operacion, count(*) FILTER (activo) AS tarjetas, count(*) AS intentos, count(titulo) AS exitos, count(precio) AS matcheados, CASE WHEN corrida_id % 3 > 0 THEN corrida_id % 3 = 1 END AS estado FROM fotos_anuncios GROUP BY ALL)
SELECT portal, tipo_operacion, count(*) AS paginas_visitadas, count(*) FILTER (tarjetas > 0) AS paginas_con_tarjetas, count(*) FILTER (tarjetas = 0) AS paginas_sin_tarjetas, CAST(sum(tarjetas) AS bigint) AS tarjetas_totales,
  CAST(sum(intentos) AS bigint) AS detalle_intentos, CAST(sum(exitos) AS bigint) AS detalle_exitos, CAST(0 AS bigint) AS postings_redux_totales, CAST(sum(matcheados) AS bigint) AS postings_matcheados,
  count(*) FILTER (estado) AS redux_paginas_ok, count(*) FILTER (NOT estado) AS redux_paginas_fallidas, true AS redux_requerido, round(CASE WHEN sum(tarjetas) > 0 THEN sum(matcheados) / sum(tarjetas) END, 4) AS ratio_match_redux_dom FROM p GROUP BY ALL""")
def q_diagnostics(s, d):
    """Counters of each scope, every snapshot being a page."""
    state = F.when(F.col("corrida_id") % 3 > 0, F.col("corrida_id") % 3 == 1)
    pages = table(s, d, "fotos_anuncios").groupBy("corrida_id", *_SCOPE).agg(
        F.count_if("activo").alias("tarjetas"), F.count("*").alias("intentos"), F.count("titulo").alias("exitos"), F.count("precio").alias("matcheados")
    ).withColumns({"estado": state, "estrategia": F.lit("navent")})
    return diagnostics.run_diagnostics(pages, _SCOPE)


@query("SELECT event_type, CAST(date_trunc('day', ts) AS timestamp) AS dia, count(*) AS n FROM events GROUP BY ALL")
def q_stream_windows(s, d):
    """Events by day, as a stream that is read to its end."""
    stream = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/event[s].parquet")
    counts = windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"])
    folder = shared_folder(s, "dias")
    written_counts(counts, folder).awaitTermination()
    return s.read.parquet(f"{folder}/conteos").select("event_type", F.col("window.start").cast("timestamp_ntz").alias("dia"), "n")


@query("""
SELECT portal, count(*) FILTER (trim(coalesce(fecha_extraccion, '')) = '') AS sin_fecha, count(*) FILTER (trim(coalesce(titulo, '')) = '') AS sin_titulo, count(*) AS filas FROM anuncios GROUP BY portal""")
def q_validation(s, d):
    checked = validate.validated(table(s, d, "anuncios"), {"sin_titulo": text.is_blank(F.col("titulo"))})
    return checked.groupBy("portal").agg(
        F.count_if(F.array_contains("errores", "fecha_extraccion")).alias("sin_fecha"), F.count_if(F.array_contains("warnings", "sin_titulo")).alias("sin_titulo"), F.count("*").alias("filas")
    )


@query(f"""
SELECT anuncio_id, CASE WHEN trim(coalesce(moneda, '')) <> '' THEN trim(moneda) WHEN trim(coalesce(serie_tc, '')) <> '' THEN trim(serie_tc) END AS valor,
  CASE WHEN trim(coalesce(moneda, '')) <> '' THEN 'moneda' WHEN trim(coalesce(serie_tc, '')) <> '' THEN 'serie' END AS origen FROM {ONCE}""")
def q_provenance(s, d):
    first = validate.first_filled({"moneda": F.col("moneda"), "serie": F.col("serie_tc")})
    return listings(s, d).select("anuncio_id", first.alias("f")).select("anuncio_id", "f.valor", "f.origen")


@query("""
SELECT series_codigos, CAST(fecha AS date) AS fecha, compra, venta FROM tipo_cambio_bcrp WHERE compra > 0 AND venta > 0""")
def q_rate_series(s, d):
    """Quotes as a service would answer, in one JSON for each series and month, read back."""
    period = F.struct(F.date_format("fecha", "dd.MM.yyyy").alias("x"), F.date_format("fecha", "yyyy-MM-dd").alias("name"), F.array(F.coalesce(F.col("compra").cast("string"), F.lit("n.d.")), F.col("venta").cast("string")).alias("values"))
    rows = table(s, d, "tipo_cambio_bcrp").groupBy("series_codigos", F.date_format("fecha", "yyyy-MM").alias("mes")).agg(F.collect_list(period).alias("periods"))
    answers = rows.select("series_codigos", F.concat(F.to_json(F.struct("periods")), F.lit(" <!-- fin -->")).alias("json"))
    return readers.rate_series(answers, "json", ["series_codigos"])


@query("""
SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(coalesce(source, '')), '[^a-z0-9_-]+', '_', 'g'), '_'), ''), 'sin_valor') || '_' ||
  coalesce(nullif(trim(regexp_replace(lower(coalesce(lang, '')), '[^a-z0-9_-]+', '_', 'g'), '_'), ''), 'sin_valor') || '_listado_p' || doc_id || '.html' AS archivo,
  CAST(octet_length(encode(text)) AS int) AS bytes FROM documents""")
def q_snapshot_facts(s, d):
    pages = table(s, d, "documents").withColumn("etapa", F.lit("Listado"))
    facts = readers.snapshot_facts(pages, "text", "source", "lang", "doc_id", "etapa")
    return facts.select(F.col("pagina").alias("doc_id"), "archivo", "bytes")


@query("""
WITH v AS (SELECT portal, count(*) FILTER (trim(coalesce(moneda, '')) <> '') / count(*) < 0.66 AS mal FROM anuncios GROUP BY portal)
SELECT CASE WHEN mal THEN 'degradadas' ELSE 'vigentes' END AS destino, count(*) AS filas, count(DISTINCT portal) AS portales FROM anuncios JOIN v USING (portal) GROUP BY 1""")
def q_degraded_route(s, d):
    rows = table(s, d, "anuncios")
    verdict = quality.quality_gate(rows, {"moneda": 0.66}, by=["portal"]).select("portal", "apta")
    return pipeline.routed(rows, verdict, ["portal"]).groupBy("destino").agg(F.count("*").alias("filas"), F.countDistinct("portal").alias("portales"))
