from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablon.operators.lifecycle import Policy
from tablon.plans.pipeline import RunRequest, process_run
from tablon.sources import portal, readers
from tablon.sources.state import VersionedTable, append_log, read_log
from tablon.streaming.runs import stream_runs

STATE = "portal string, tipo_operacion string, enlace string, titulo string, primera_vez_visto timestamp_ntz, ultima_vez_visto timestamp_ntz, ausencias_consecutivas int, activo boolean, fecha_baja date"


def schema(spark, ddl):
    return StructType.fromDDL(ddl)


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "state"), schema(spark, "a int"))
    assert t.read().isEmpty() and t.version() is None
    assert t.write(spark.range(3).selectExpr("cast(id as int) a")) == 1
    assert t.write(t.read().where("a > 0")) == 2
    assert t.read().count() == 2 and t.read(1).count() == 3


def test_log(spark, tmp_path):
    ddl = schema(spark, "corrida_id long, x string")
    path = str(tmp_path / "log")
    assert read_log(spark, path, ddl).isEmpty()
    for i in (1, 2):
        append_log(spark.createDataFrame([(i, "x")], ddl), path)
    assert [r[0] for r in read_log(spark, path, ddl).collect()] == [2, 1]


def test_stream_of_runs_is_idempotent(spark, tmp_path):
    rows = "corrida_id long, fecha timestamp_ntz, portal string, tipo_operacion string, enlace string, titulo string"
    source = str(tmp_path / "in")
    data = [(1, datetime(2026, 1, 1), "p", "v", "h/1", "a"), (1, datetime(2026, 1, 1), "p", "v", "h/2", "b"), (2, datetime(2026, 1, 8), "p", "v", "h/1", "c")]
    spark.createDataFrame(data, rows).coalesce(1).write.parquet(source)
    table = VersionedTable(spark, str(tmp_path / "state"), schema(spark, STATE))
    columns = ["portal", "tipo_operacion", "enlace", "titulo"]
    for n in range(2):  # the second time with a checkpoint that is lost
        stream = spark.readStream.schema(rows).parquet(source)
        stream_runs(stream, table, str(tmp_path / f"check{n}"), ["portal", "tipo_operacion"], "corrida_id", "fecha", Policy(absences=1), columns).awaitTermination()
        got = {r["enlace"]: (r["titulo"], r["activo"]) for r in table.read().collect()}
        assert got == {"h/1": ("c", True), "h/2": ("b", False)} and table.version() == 1


def test_references(spark):
    found = spark.createDataFrame([("a",), ("b",)], "enlace_canon string")
    assert [r[0] for r in portal.new_references(found, found.where("enlace_canon = 'a'")).collect()] == ["b"]
    urls = spark.createDataFrame([("https://x/y",), ("/a/b",), ("c",)], "u string")
    assert [r[0] for r in urls.select(portal.absolute_url("https://h.example/", F.col("u"))).collect()] == ["https://x/y", "https://h.example/a/b", "https://h.example/c"]


def test_portal_reader():
    class Fake:
        fuente = "f"

        def discover(self, operation):
            return [portal.Reference(f"h/{i}", "f", str(i), operation) for i in range(5)]

        def detail(self, ref):
            return None if ref.id_externo == "3" else {"t": ref.id_externo}

    portal.register_portal("fake", Fake)
    reader = portal._Reader({"portal": "fake", "operacion": "venta", "tramo": "2"})
    parts = reader.partitions()
    rows = [r for p in parts for r in reader.read(p)]
    assert len(parts) == 3 and [r[2] for r in rows] == ["0", "1", "2", "4"] and rows[0][3] == "venta"


def test_a_run_from_raw_to_state(spark, tmp_path):
    state = VersionedTable(spark, str(tmp_path / "state"), schema(spark, "sector string, " + STATE))
    log_ddl = schema(spark, "corrida_id long, fecha timestamp_ntz, sector string, portal string, tipo_operacion string, id_fuente string, listado_completo boolean, estado_calidad string, n_total long, n_nuevos long, n_repetidos long")
    raw = spark.createDataFrame([("h/1", "a", "2026-05-01"), ("h/2?x", "b", None), (None, None, None)], "enlace string, titulo string, fecha_publicacion string")

    def run(n, source, rows, **more):
        log = read_log(spark, str(tmp_path / "log"), log_ddl)
        request = RunRequest(datetime(2026, 5, n), n, source, "s", "p", "v", **more)
        return process_run(rows, request, state, log, str(tmp_path / "log"), str(tmp_path / "bad"), Policy(absences=1), ["titulo"])

    assert run(1, "x1", raw) == "ok"
    assert run(2, "x1", raw) == "ya_registrado"
    assert run(3, "x2", raw.where("enlace = 'h/1'")) == "ok"
    assert {r["enlace"]: r["activo"] for r in state.read().collect()} == {"h/1": True, "h/2": False}
    assert run(4, "x3", raw.withColumn("titulo", F.lit(" ")).dropna("any", subset=["enlace"])) == "degradado"
    assert run(5, "x4", raw.limit(0)) == "sin_datos" and state.version() == 2
    log = read_log(spark, str(tmp_path / "log"), log_ddl).collect()
    assert [(r["corrida_id"], r["n_total"], r["n_nuevos"], r["n_repetidos"]) for r in log] == [(3, 1, 0, 1), (1, 2, 2, 0)]
    assert spark.read.parquet(str(tmp_path / "bad" / "corrida=4")).count() == 2


def test_the_log_counts_the_newly_absent(spark, tmp_path):
    state = VersionedTable(spark, str(tmp_path / "state"), schema(spark, "sector string, " + STATE))
    log_ddl = schema(spark, "corrida_id long, sector string, portal string, tipo_operacion string, id_fuente string, n_total long, n_nuevos long, n_repetidos long, n_desaparecidos long")
    for n, links in enumerate([["h/1", "h/2", "h/3"], ["h/1", "h/2"], ["h/1"], ["h/1", "h/3"], ["h/1"]], 1):
        rows = spark.createDataFrame([(e, "t") for e in links], "enlace string, titulo string")
        log = read_log(spark, str(tmp_path / "log"), log_ddl)
        process_run(rows, RunRequest(datetime(2026, 5, n), n, f"x{n}", "s", "p", "v", complete=n < 5), state, log, str(tmp_path / "log"), str(tmp_path / "bad"), Policy(absences=2), ["titulo"])
    # Run 3: h/3 is retired, h/2 is away once. Run 4: h/2 is retired, h/3 is back. Run 5 is partial.
    log = read_log(spark, str(tmp_path / "log"), log_ddl).collect()
    assert [(r["n_total"], r["n_nuevos"], r["n_repetidos"], r["n_desaparecidos"]) for r in reversed(log)] == [(3, 3, 0, 0), (2, 0, 2, 1), (1, 0, 1, 2), (2, 0, 2, 1), (1, 0, 1, 0)]


def test_rate_series(spark):
    text = '{"periods": [{"name": "16.May.26", "values": ["3.7", "3,8"]}, {"name": "17/05/2026", "values": ["n.d.", "3.9"]}, {"name": "2026-05-18", "values": ["3.6", "3.75"]}, {"name": "x", "values": ["1", "2"]}]} junk'
    df = spark.createDataFrame([(text,), (None,), ("nada",)], "t string")
    assert sorted((str(r["fecha"]), r["compra"], r["venta"]) for r in readers.rate_series(df, "t").collect()) == [("2026-05-16", 3.7, 38.0), ("2026-05-18", 3.6, 3.75)]


def test_reference_list(spark):
    names = {"distrito": ["distrito"], "nse": ["nse", "clasificacion"]}
    shifted = spark.createDataFrame([(0, "Informe", None), (1, "Distrito", "Clasificación"), (2, "uno", "alto"), (3, "dos", None)], "_orden int, a string, b string")
    assert [tuple(r) for r in readers.reference_list(shifted, names).collect()] == [("uno", "alto")]
    plain = spark.createDataFrame([("uno", "alto")], "DISTRITO string, NSE string")
    assert [tuple(r) for r in readers.reference_list(plain, names).collect()] == [("uno", "alto")]
    assert readers.reference_list(plain.select("NSE"), names) is None


def test_pages(spark):
    pages = spark.createDataFrame([("<title> A b </title><h1><b>x</b> y</h1>", "P", "Venta", 3, "Lista")], "h string, p string, o string, n int, e string")
    row = readers.snapshot_facts(pages, "h", "p", "o", "n", "e").first()
    assert (row["archivo"], row["titulo"], row["desafio"]) == ("p_venta_lista_p3.html", "A b", False)
    assert pages.select(readers.element_text(F.col("h"), ["<h2>(.*?)</h2>", "<h1>(.*?)</h1>"])).first()[0] == "x y"
