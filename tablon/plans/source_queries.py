"""Queries of what reads, keeps and lays out records: references, states, sheets, pages, tables of documents, answers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablon.functions import dates, identity, money, text
from tablon.operators import accumulate, documents, embedded, enrich, lookup
from tablon.plans import pipeline
from tablon.plans.reference_queries import _BOXES, _CUTS, ONCE, _area, _boxes, canon_sql, listings, query
from tablon.session import shared_folder
from tablon.sources import portal, readers, state
from tablon.sources.tables import table


@query("""
SELECT anuncio_id, CASE WHEN m IN ('S/', 'PEN', 'SOLES') THEN 'PEN' WHEN m IN ('USD', 'US$', '$', 'U$S', 'DOLARES') THEN 'USD' END AS iso
FROM (SELECT anuncio_id, replace(replace(upper(moneda), ' ', ''), '.', '') AS m FROM anuncios)""")
def q_currency_iso(s, d):
    return table(s, d, "anuncios").select("anuncio_id", money.currency_iso(F.col("moneda")).alias("iso"))


@query("SELECT o_orderkey, CAST(o_orderdate AS date) AS dia FROM orders")
def q_iso_dates(s, d):
    """Order dates in five forms, read back; with the day first only where it can't be a month."""
    k, at = F.col("o_orderkey") % 5, F.col("o_orderdate")
    last = F.when(F.dayofmonth(at) > 12, F.date_format(at, "dd/MM/yyyy")).otherwise(F.date_format(at, "MM/dd/yyyy"))
    forms = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "yyyy/M/d")).when(k == 2, F.date_format(at, "yyyyMMdd")).when(k == 3, last).otherwise(at.cast("string"))
    return table(s, d, "orders").select("o_orderkey", dates.iso_date(forms).alias("dia"))


@query("SELECT tc_id, CAST(fecha AS date) AS dia FROM tipo_cambio_bcrp")
def q_series_days(s, d):
    """Days of quotes under the names that a series gives its periods, read back."""
    at, k = F.col("fecha"), F.col("tc_id") % 4
    months = F.array(*[F.lit(m) for m in ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Set", "Oct", "Nov", "Dic")])
    month = F.get(months, F.month(at) - 1)
    name = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "dd/MM/yyyy")).when(
        k == 2, F.concat(F.date_format(at, "dd."), month, F.date_format(at, ".yy"))
    ).otherwise(F.concat(F.date_format(at, "d "), F.date_format(at, "MMM"), F.date_format(at, " yyyy")))
    return table(s, d, "tipo_cambio_bcrp").select("tc_id", readers.series_day(name).alias("dia"))


@query(f"""
SELECT anuncio_id, 'clasificados:' || coalesce(nullif(lower(trim(portal)), ''), 'sin_portal') || ':sin_operacion:url:' || substr(sha1({canon_sql('enlace')}), 1, 16) AS publicacion_id FROM anuncios""")
def q_frame_ids(s, d):
    """Publication ids of a frame that has neither operation nor posting, and calls its link otherwise."""
    rows = table(s, d, "anuncios").select("anuncio_id", "portal", F.col("enlace").alias("url"))
    return identity.with_publication_id(rows, F.lit("Clasificados"), link="url").select("anuncio_id", "publicacion_id")


@query("""
SELECT anuncio_id, '{"activo":' || coalesce(CAST(activo AS varchar), 'null') || ',"corrida":' || coalesce(CAST(corrida_id AS varchar), 'null') || ',"portal":' || coalesce('"' || portal || '"', 'null') || '}' AS texto FROM anuncios""")
def q_json_text(s, d):
    c = {"portal": F.col("portal"), "activo": F.col("activo"), "corrida": F.col("corrida_id")}
    return table(s, d, "anuncios").select("anuncio_id", text.sorted_json(c).alias("texto"))


@query("""
SELECT e.event_id, CAST(count(*) FILTER (value IS NOT NULL AND NOT isnan(value)) AS int) AS n FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST('nan' AS double) ELSE value END AS value FROM events) e GROUP BY event_id""")
def q_number_or_null(s, d):
    v = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(s, d, "events").select("event_id", text.or_null(v).isNotNull().cast("int").alias("n"))


@query(f"""
WITH p AS (SELECT 'portal' AS hoja, portal AS clave, enlace, titulo, {canon_sql('enlace')} AS c, corrida_id, recibido_en FROM fotos_anuncios WHERE enlace IS NOT NULL)
SELECT hoja, CAST(count(*) AS bigint) AS filas, CAST(count(titulo) AS bigint) AS titulos FROM (
  SELECT hoja, titulo FROM p QUALIFY row_number() OVER (PARTITION BY clave, c ORDER BY corrida_id % 2 DESC, corrida_id DESC, recibido_en DESC) = 1) GROUP BY hoja
UNION ALL SELECT 'corridas', count(*), count(portal) FROM corridas""")
def q_sheets(s, d):
    """Two declared sheets: one grows by new rows, one has none that are new; a third isn't declared and goes."""
    rows = table(s, d, "fotos_anuncios").where("enlace is not null").select("portal", identity.canonical_link(F.col("enlace")).alias("c"), "titulo", "corrida_id", F.struct("corrida_id", "recibido_en").alias("__ord"))
    keys = ["portal", "c"]
    old = accumulate.keep_last(rows.where("corrida_id % 2 = 0"), keys, [F.col("__ord")]).drop("__ord")
    runs = table(s, d, "corridas")
    sheets = [accumulate.Sheet("portal", keys), accumulate.Sheet("corridas", ["corrida_id"])]
    out = accumulate.accumulate_sheets({"portal": old, "corridas": runs, "otra": runs}, {"portal": rows.where("corrida_id % 2 = 1")}, sheets)
    counted = [df.select(F.lit(n).alias("hoja"), F.col("titulo" if n == "portal" else "portal").alias("t")).groupBy("hoja").agg(F.count("*").alias("filas"), F.count("t").alias("titulos")) for n, df in out.items()]
    return accumulate.union_all(counted)


@query(f"SELECT anuncio_id, portal, titulo FROM anuncios WHERE sector = 'inmobiliario' AND portal = 'nidoaviso' AND activo")
def q_history_scan(s, d):
    return state.read_listings(table(s, d, "anuncios"), "inmobiliario", "nidoaviso", only_active=True, columns=["anuncio_id", "no_existe", "portal", "titulo"])


@query("SELECT anuncio_id, enlace, precio FROM anuncios WHERE sector = 'empleo'")
def q_view(s, d):
    """The view of a sector, written anew from the state and read back."""
    path = state.regenerate_view(state.read_listings(table(s, d, "anuncios"), "empleo", columns=["anuncio_id", "enlace", "precio"]), shared_folder(s, "vista"))
    return s.read.parquet(path) if path else table(s, d, "anuncios").select("anuncio_id", "enlace", "precio").where("false")


_OLD = "SELECT portal, tipo_operacion, enlace, titulo, ultima_vez_visto FROM anuncios"


@query(f"""
WITH o AS (SELECT *, {canon_sql('enlace')} AS c FROM ({_OLD}))
SELECT 'inmobiliario|' || coalesce(trim(portal), '') || '|tipo_operacion|' || coalesce(trim(tipo_operacion), '') || '|' || c AS clave_registro, c AS enlace, max(ultima_vez_visto) AS ultima_vez_visto, 0 AS ausencias_consecutivas, true AS activo,
  CAST(NULL AS date) AS fecha_baja FROM o GROUP BY portal, tipo_operacion, c""")
def q_migrated_state(s, d):
    """A state of raw links, without keys and counters, in the present form."""
    old = table(s, d, "anuncios").select("portal", "tipo_operacion", "enlace", "titulo", "ultima_vez_visto")
    needed = StructType.fromDDL("ausencias_consecutivas int, activo boolean, fecha_baja date")
    return state.migrated_state(old, "inmobiliario", "tipo_operacion", needed).select("clave_registro", "enlace", "ultima_vez_visto", "ausencias_consecutivas", "activo", "fecha_baja")


@query(f"SELECT {canon_sql('enlace')} AS canonico, count(*) AS veces FROM anuncios GROUP BY 1 HAVING count(*) > 1")
def q_repeated_keys(s, d):
    rows = table(s, d, "anuncios").select(identity.canonical_link(F.col("enlace")).alias("canonico"))
    return state.repeated_keys(rows, ["canonico"])


@query(f"SELECT pagina, regexp_replace(string_agg(texto, '\n' ORDER BY round_even(x0 / 50.0, 0), y0, x0, texto), '[NA](\\d)', 'x\\1', 'g') AS texto FROM {_BOXES} WHERE tipo = 0 GROUP BY pagina")
def q_page_texts(s, d):
    """Texts of pages without their noise: a letter before a figure."""
    pages = readers.page_texts(_boxes(s, d), ["pagina"], noise=r"[NA](?=[0-9])")
    return pages.select("pagina", F.regexp_replace("texto", r"(?m)^([0-9])", "x$1").alias("texto"))


_TABLES = f"""WITH {_CUTS}, w AS (SELECT b.*, CAST(dense_rank() OVER (PARTITION BY pagina ORDER BY y0) - 1 AS int) AS fila, (SELECT count(*) FROM k WHERE k.pagina = b.pagina AND (b.x0 + b.x1) / 2 > corte) AS col FROM {_BOXES} b),
a AS (SELECT pagina, CAST(count(DISTINCT fila) AS bigint) AS n_filas, CAST(1 + (SELECT count(*) FROM k WHERE k.pagina = w.pagina) AS int) AS n_columnas FROM w GROUP BY pagina)"""


@query(_TABLES + """
SELECT pagina, CASE WHEN pagina % 3 = 0 THEN 'lattice' ELSE 'stream' END AS metodo, CASE WHEN pagina % 3 = 0 THEN 1 ELSE n_filas END AS n_filas, CASE WHEN pagina % 3 = 0 THEN 2 ELSE n_columnas END AS n_columnas FROM a""")
def q_document_tables(s, d):
    """Tables by lines where a page has one, else by words, with their shapes."""
    boxes = _boxes(s, d)
    ruled = boxes.where("pagina % 3 = 0").select("pagina").distinct().select("pagina", F.lit(0).alias("tabla"), F.lit(0).alias("fila"), F.array(F.lit("a"), F.lit("")).alias("celdas"))
    chosen = documents.chosen_tables(ruled, documents.stream_tables(boxes, ["pagina"]), ["pagina"])
    return documents.table_shape(chosen, ["pagina", "tabla", "metodo"]).select("pagina", "metodo", "n_filas", "n_columnas")


_ROUTES = ({"cobertura": ["limpieza.py"], "detalle": ["detalle.py", "texto.py"]}, {"nidoaviso": ["nido.py"], "faenadia": ["faena.py"]}, ["portal.py", "scraper.py"])


@query("""
SELECT anuncio_id, CASE WHEN sector = 'empleo' THEN 'detalle.py,texto.py' WHEN portal = 'nidoaviso' THEN 'nido.py' WHEN portal = 'faenadia' THEN 'faena.py' ELSE 'portal.py,scraper.py' END AS archivos FROM anuncios""")
def q_routes(s, d):
    kind = F.when(F.col("sector") == "empleo", "detalle").otherwise(F.col("sector"))
    return table(s, d, "anuncios").select("anuncio_id", F.array_join(lookup.first_route(kind, F.col("portal"), *_ROUTES), ",").alias("archivos"))


@query("SELECT p.portal, o.operacion FROM portales p CROSS JOIN (VALUES ('venta'), ('alquiler')) o(operacion) WHERE p.portal IS NOT NULL")
def q_run_plan(s, d):
    """A run for each portal and operation."""
    portals = [r[0] for r in table(s, d, "portales").select("portal").where("portal is not null").collect()]  # parameters of a run
    return s.createDataFrame(pipeline.planned_runs(portals, ["venta", "alquiler"]), "portal string, operacion string")


_STATE_HTML = """'<html><script id="__NEXT_DATA__" type="application/json">{"a": [{"z": null}, {"props": ' || props || '}], "tipo": "' || event_type || '", "z": {"n": ' || event_id || '}}</script></html>'"""


@query("SELECT event_id, 'k=' || json_extract_string(props, '$.k') || ';tipo=\"' || event_type || '\";z={\"n\": ' || event_id || '}' AS claves FROM events")
def q_page_values(s, d):
    """Several keys of a page's state at a time; one is null where it comes first, one isn't there."""
    html = table(s, d, "events").select("event_id", F.expr(_STATE_HTML).alias("html"))
    found = html.select("event_id", embedded.found_keys(["k", "tipo", "z", "nada"])(embedded.page_state(F.col("html"))).alias("m"))
    return found.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("claves"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 2 ELSE 1 END AS n FROM events")
def q_stored_files(s, d):
    """Stored pages that name their file: none of a record's, both of two, one of two."""
    named = F.to_json(F.array(F.struct(F.lit("a.html").alias("archivo")), F.struct(F.concat(F.lit("p"), F.col("event_id")).alias("archivo"))))
    partly = F.lit('[{"archivo": ""}, {"archivo": "b.html", "bytes": "7"}, {"url": "x"}]')
    lists = F.when(F.col("event_id") % 3 == 0, F.lit('[{"url": "x"}]')).when(F.col("event_id") % 3 == 1, named).otherwise(partly)
    return table(s, d, "events").select("event_id", F.size(embedded.stored_files(lists)).alias("n"))


@query("""
SELECT event_id, posicion, 'https://h.example/' || event_type || '/' || posicion AS enlace, CASE WHEN event_id % 2 = 0 THEN CAST(posicion AS varchar) END AS id_externo, CASE WHEN event_id % 2 = 0 THEN 'estado' ELSE 'html' END AS via
FROM events, (VALUES (0), (1)) v(posicion)""")
def q_listing_references(s, d):
    """References of listing pages, by their state or, where that has none, by their links."""
    def state_of(i):
        return '{"id": ' + str(i) + ', "ruta": {"url": "https://h.example/\' || event_type || \'/' + str(i) + '"}}'

    inside = f"""'<script id="__NEXT_DATA__" type="application/json">{{"p": {{"postings": [{state_of(0)}, {state_of(1)}]}}}}</script>'"""
    plain = """'<a class="x" href="https://h.example/' || event_type || '/0">a</a><a class="x" href="https://h.example/' || event_type || '/1">b</a>'"""
    pages = table(s, d, "events").select("event_id", F.expr(f"CASE WHEN event_id % 2 = 0 THEN {inside} ELSE {plain} END").alias("html"))
    return portal.listing_references(pages, "html", "postings", {"enlace": "$.ruta.url", "id_externo": "$.id"}, r'<a class="x" href="([^"]+)"')


@query("SELECT anuncio_id, nullif(trim(regexp_replace(titulo, '\\s+', ' ', 'g')), '') AS texto FROM anuncios WHERE titulo IS NULL OR NOT regexp_matches(titulo, '[<>]')")
def q_element_text(s, d):
    """The text of a page's first heading that isn't blank."""
    rows = table(s, d, "anuncios").where("titulo is null or not titulo rlike '[<>]'")
    html = F.concat(F.lit("<div><h1 class='a'> <b></b> </h1><h2>"), F.coalesce("titulo", F.lit("")), F.lit("</h2></div>"))
    return rows.select("anuncio_id", readers.element_text(html, [r"(?s)<h1[^>]*>(.*?)</h1>", r"(?s)<h2[^>]*>(.*?)</h2>"]).alias("texto"))


@query("SELECT anuncio_id, CASE WHEN regexp_matches(ruta, '^https?://') THEN ruta ELSE 'https://base.example/sub/' || ltrim(ruta, '/') END AS url FROM (SELECT anuncio_id, CASE WHEN anuncio_id % 2 = 0 THEN enlace ELSE '//' || id_portal || '/x' END AS ruta FROM anuncios)")
def q_absolute_urls(s, d):
    path = F.when(F.col("anuncio_id") % 2 == 0, F.col("enlace")).otherwise(F.concat(F.lit("//"), F.col("id_portal"), F.lit("/x")))
    return table(s, d, "anuncios").select("anuncio_id", portal.absolute_url("https://base.example/sub/", path).alias("url"))


class _Counting:
    """A provider that answers with the length of each text, in an object; it doesn't answer for texts of 50 letters."""

    def generate(self, prompt: str) -> str:
        asked = json.loads(prompt.split("\n", 1)[1])
        return json.dumps({"total": len(asked), "items": [{"id": a["id"], "n": len(a["texto"])} for a in asked if len(a["texto"]) != 50] + ["?"]})


@query("""
SELECT doc_id, CASE WHEN lang = 'en' THEN 'antes' WHEN length(text) <> 50 AND trim(text) <> '' THEN CAST(length(text) AS varchar) END AS valor FROM documents WHERE text IS NOT NULL AND trim(text) <> ''""")
def q_enriched(s, d):
    """Documents with answers: from the cache where it has one, else from the provider."""
    docs = table(s, d, "documents").where("text is not null and trim(text) <> ''")
    rows = docs.select(F.col("doc_id").cast("string").alias("publicacion_id"), text.content_hash(F.col("text")).alias("descripcion_hash"), F.col("text").alias("texto"), "lang")
    cache = rows.where("lang = 'en'").select("publicacion_id", "descripcion_hash", F.lit("antes").alias("valor"))
    known, _ = enrich.enrich_with_cache(rows, cache, _Counting(), "cuenta\n", "n")
    return known.select(F.col("publicacion_id").cast("bigint").alias("doc_id"), "valor")


# The lookup in SQL: the same rule step by step over one list of parts, and the text stage as a comparison of every name with
# every text. Districts and prefixes are the parameters of the area.
_PREFIX = "urb|urbanizacion|residencial|quinta|villa|condominio|asoc|asociacion|coop|cooperativa|pueblo tradicional|pueblo joven"
_WAY = "av|avenida|calle|jr|jiron|pasaje|psje|prolongacion|ovalo|plaza|parque|via"
_NO_PLACE = "['venta', 'alquiler', 'departamento', 'departamentos', 'casa', 'casas', 'terreno', 'terrenos', 'habitacion', 'habitaciones', 'inmueble', 'inmuebles']"


def _place(t: str) -> str:
    kept = f"regexp_replace(strip_accents(lower(trim(coalesce({t}, '')))), '[^\\w\\s./,;|-]', ' ', 'g')"
    sold = f"regexp_replace({kept}, '\\b(en|de|del|la|el|los|las)\\s+(venta|alquiler)\\b', ' ', 'g')"
    return f"regexp_replace(regexp_replace({sold}, '\\s+', ' ', 'g'), '^[ .,;|/-]+|[ .,;|/-]+$', '', 'g')"


def _names(source: str, out: str) -> str:
    """Tables that end in ``out`` (id, nombre, pos): names in the texts ``ts`` of ``source`` (id, ts), each once for an id."""
    return f"""
{out}1 AS (SELECT id, j, u.i AS i, trim(u.p) AS s FROM (SELECT id, tx.j, regexp_split_to_array(tx.x, '[,;|]+') AS ps FROM {source}, unnest(list_transform(ts, lambda x, j: {{'j': j, 'x': x}})) _(tx)) q, unnest(list_transform(q.ps, lambda p, i: {{'i': i, 'p': p}})) _(u)),
{out}2 AS (SELECT *, coalesce(nullif(regexp_extract(s, '\\b(?:{_PREFIX})\\.?\\s+[a-z0-9\\s.-]{{3,60}}'), ''), s) AS w FROM {out}1),
{out}3 AS (SELECT *, CASE WHEN regexp_matches(w, '\\b(?:{_WAY})\\.?\\b') AND trim(regexp_extract(w, '^(.*?)\\b(?:{_WAY})\\.?\\b', 1)) <> '' THEN regexp_extract(w, '^(.*?)\\b(?:{_WAY})\\.?\\b', 1) ELSE w END AS l FROM {out}2),
{out}4 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '\\b(en|de|del|la|el|los|las)\\b', ' ', 'g'), '\\b(?:urb|urbanizacion|residencial|condominio|asoc|asociacion|coop|cooperativa)\\b\\.?', ' ', 'g'), '\\s+', ' ', 'g'), '^[ ./-]+|[ ./-]+$', '', 'g') AS t FROM {out}3),
{out}5 AS (SELECT * REPLACE (coalesce((SELECT regexp_replace(substr(t, 1, length(t) - length(z.d) - 1), '[ ./-]+$', '') FROM zonas z WHERE ends_with(t, ' ' || z.d) ORDER BY length(z.d) DESC LIMIT 1), t) AS t) FROM {out}4),
{out}6 AS (SELECT *, string_split(t, ' ') AS ws FROM {out}5),
{out}7 AS (SELECT id, j, i, CASE WHEN len(ws) % 2 = 0 AND ws[:len(ws) // 2] = ws[len(ws) // 2 + 1:] THEN array_to_string(ws[:len(ws) // 2], ' ') ELSE t END AS nombre FROM {out}6),
{out} AS (SELECT id, nombre, min((j, i)) AS pos FROM {out}7 WHERE length(nombre) >= 4 AND NOT regexp_matches(nombre, '^(?:{_WAY})\\b') AND len(string_split(nombre, ' ')) <= 6
  AND len(list_filter(string_split(nombre, ' '), lambda x: NOT list_contains({_NO_PLACE}, x))) > 0 AND nombre NOT IN (SELECT d FROM zonas) GROUP BY id, nombre)"""


_LABEL = "CASE trim(regexp_replace({0}, '[\\s-]+', ' ', 'g')) WHEN 'alto' THEN 'Alto' WHEN 'allto' THEN 'Alto' WHEN 'medio alto' THEN 'Medio Alto' WHEN 'media alto' THEN 'Medio Alto' WHEN 'medio' THEN 'Medio' WHEN 'medio bajo' THEN 'Medio Bajo' WHEN 'bajo' THEN 'Bajo' END"
_DISTRICT = "coalesce((SELECT max(z.d) FROM alias z WHERE z.a = {0}), {0})"


def _mode_sql(keys: str) -> str:
    return f"""SELECT {keys}, arg_max(nse, (n, -o)) AS nse, max(n) / sum(n) AS confianza, CAST(sum(n) AS bigint) AS n, min(o) AS orden
  FROM (SELECT {keys}, nse, count(*) AS n, min(orden) AS o FROM filas GROUP BY ALL) GROUP BY ALL HAVING sum(n) >= 2"""


_INDEX = f"""
WITH zonas AS (SELECT {_place('nombre')} AS d FROM distritos), alias AS (SELECT {_place('alias_texto')} AS a, {_place('nombre')} AS d FROM distritos_alias JOIN distritos USING (distrito_id)),
fuente AS (SELECT lugar_id AS id, [{_place('lugar')}] AS ts FROM lugares_nse), {_names('fuente', 'nombres')},
lugares AS (SELECT lugar_id AS id, {_place('distrito')} AS e, {_LABEL.format(_place('nse'))} AS nse FROM lugares_nse),
filas AS (SELECT {_DISTRICT.format('l.e')} AS distrito, nombre, nse, l.id AS orden FROM lugares l JOIN nombres USING (id) WHERE l.e <> '' AND nse IS NOT NULL),
aca AS ({_mode_sql('distrito, nombre')}), todo AS ({_mode_sql('nombre')})"""


@query(_INDEX + " SELECT distrito, nombre, nse, confianza, n, orden FROM aca UNION ALL SELECT NULL, nombre, nse, confianza, n, orden FROM todo")
def q_lookup_index(s, d):
    """Labels of names within districts, and of names."""
    local, everywhere = lookup.build_index(table(s, d, "lugares_nse"), "lugar_id", _area(s, d))
    return local.unionByName(everywhere.withColumn("distrito", F.lit(None).cast("string")))


_CASCADE = f"""{_INDEX},
avisos AS (SELECT anuncio_id AS id, {_DISTRICT.format(_place('distrito'))} AS distrito, [{_place('ubicacion')}, {_place('nse_match')}] AS ts, {_place("concat_ws(' ', ubicacion, nse_match)")} AS t FROM {ONCE}), {_names('avisos', 'citas')},
x AS (
  SELECT id, 1 AS r, pos, nombre, nse, confianza FROM citas JOIN avisos USING (id) JOIN aca USING (distrito, nombre)
  UNION ALL SELECT id, 2, pos, nombre, nse, confianza FROM citas JOIN todo USING (nombre)
  UNION ALL SELECT id, 3, (-length(nombre), g.orden), nombre, coalesce(l.nse, g.nse), coalesce(l.confianza, g.confianza)
    FROM avisos JOIN todo g ON contains(t, nombre) AND (length(nombre) >= 8 OR contains(nombre, ' ')) AND regexp_matches(t, '\\b' || regexp_escape(nombre) || '\\b') LEFT JOIN aca l USING (distrito, nombre)),
b AS (SELECT id, arg_min((r, nombre, nse, confianza), (r, pos)) AS h FROM x GROUP BY id)
"""
_HIT = "CASE h[1] WHEN 1 THEN 'urbanizacion_distrito' WHEN 2 THEN 'urbanizacion_global' WHEN 3 THEN 'urbanizacion_texto' END"


def _classified(s: SparkSession, d: str) -> DataFrame:
    config = _area(s, d)
    index = lookup.build_index(table(s, d, "lugares_nse"), "lugar_id", config)
    return lookup.classify(listings(s, d), index, "anuncio_id", ["ubicacion", "nse_match"], "distrito", config)


@query(_CASCADE + f"SELECT a.id AS anuncio_id, h[3] AS nse, {_HIT} AS metodo, h[2] AS nombre, round(h[4], 4) AS confianza FROM avisos a LEFT JOIN b USING (id)")
def q_lookup_cascade(s, d):
    """The label of every listing's place."""
    return _classified(s, d)


@query(_CASCADE + f"SELECT {_HIT} AS metodo, count(*) AS filas, count(h[3]) AS asignadas, CAST(floor(count(h[3]) * 100 / count(*)) AS int) AS pct FROM avisos a LEFT JOIN b USING (id) GROUP BY 1")
def q_lookup_share(s, d):
    """How many listings have a label, by how it was found."""
    return lookup.assigned_share(_classified(s, d), by=["metodo"])
