"""Operators over references, states, documents and settings."""

import os
from datetime import date, datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablon import config
from tablon.functions import numbers, text
from tablon.operators import accumulate, documents, duplicates, embedded, fx, lifecycle, lookup
from tablon.operators.asof import asof_backward
from tablon.plans import pipeline
from tablon.sources import modules, portal, readers, state

SCOPE = ["portal", "tipo_operacion"]
STATE = "portal string, tipo_operacion string, enlace string, titulo string, primera_vez_visto timestamp_ntz, ultima_vez_visto timestamp_ntz, ausencias_consecutivas int, activo boolean, fecha_baja date"


def at(day):
    return datetime(2026, 1, day)


def batch(spark, links, portal_="p", operation="v"):
    return spark.createDataFrame([(portal_, operation, e, "t") for e in links], "portal string, tipo_operacion string, enlace string, titulo string")


class TestRuns:
    def test_absences_in_a_scope_of_nulls(self, spark):
        policy, scope = lifecycle.Policy(absences=2), [{"portal": "p", "tipo_operacion": None}]
        old = lifecycle.apply_run(spark.createDataFrame([], STATE), batch(spark, ["h/1", "h/2"], operation=None), lifecycle.Run(at(1)), policy, SCOPE)
        for covers in (None, scope):
            new = {r["enlace"]: r for r in lifecycle.apply_run(old.drop("estado_anuncio"), batch(spark, ["h/1"], operation=None), lifecycle.Run(at(2)), policy, SCOPE, covers=covers).collect()}
            assert len(new) == 2 and new["h/2"]["ausencias_consecutivas"] == 1 and new["h/1"]["estado_anuncio"] == "repetido"

    @pytest.mark.parametrize(("mutate", "quality", "absent"), [(None, "ok", 1), (None, " Degradada ", 0), (True, "degradado", 1), (False, "ok", 0)])
    def test_an_empty_run_and_the_override(self, spark, mutate, quality, absent):
        policy, scope = lifecycle.Policy(), [{"portal": "p", "tipo_operacion": "v"}]
        old = lifecycle.apply_run(spark.createDataFrame([], STATE), batch(spark, ["h/1"]).unionAll(batch(spark, ["h/9"], "q")), lifecycle.Run(at(1)), policy, SCOPE).drop("estado_anuncio")
        run = lifecycle.Run(at(2), quality=quality, mutate=mutate)
        new = {r["enlace"]: r["ausencias_consecutivas"] for r in lifecycle.apply_run(old, batch(spark, []), run, policy, SCOPE, covers=scope).collect()}
        assert new == {"h/1": absent, "h/9": 0}

    def test_statistics_have_all_keys(self, spark):
        policy = lifecycle.Policy(absences=1, collapse_base=3)
        old = lifecycle.apply_run(spark.createDataFrame([], STATE), batch(spark, ["h/1", "h/2"]), lifecycle.Run(at(1)), policy, SCOPE).drop("estado_anuncio")
        run = lifecycle.Run(at(2))
        new = lifecycle.apply_run(old, batch(spark, ["h/2", "h/3", "h/3"]), run, policy, SCOPE)
        got = lifecycle.run_statistics(old, new, SCOPE, run, policy, 3, "s").first().asDict()
        assert got == {"total": 2, "nuevos": 1, "repetidos": 1, "desaparecidos": 1, "dados_de_baja": 1, "duplicados_descartados": 1, "omitido_por_rerun": False,
                       "mutacion_desaparecidos": True, "listado_completo": True, "colapso_listado": False, "id_fuente": "s"}
        skipped = lifecycle.skipped_statistics(batch(spark, ["h/2", "h/3", "h/3"]), SCOPE, None, "s").first().asDict()
        assert skipped["omitido_por_rerun"] and skipped["duplicados_descartados"] == 1 and len(skipped) == 8

    def test_a_run_touches_its_scope_only(self, spark, tmp_path):
        ddl = StructType.fromDDL("sector string, " + STATE)
        table = state.ScopedTable(spark, str(tmp_path / "s"), ddl, pipeline.SCOPE)
        log, path = StructType.fromDDL("corrida_id int, fecha timestamp_ntz, sector string, portal string, tipo_operacion string, id_fuente string, listado_completo boolean, estado_calidad string, n_total bigint, n_nuevos bigint, n_repetidos bigint, n_desaparecidos bigint"), str(tmp_path / "log")
        assert table.read().isEmpty()
        for i, (name, links) in enumerate([("p", ["h/1", "h/2"]), ("q", ["h/1"]), ("p", ["h/1"])], 1):
            raw = spark.createDataFrame([(e, "t") for e in links], "enlace string, titulo string")
            request = pipeline.RunRequest(at(i), i, f"f{i}", "s", name, "v")
            assert pipeline.process_run(raw, request, table, state.read_log(spark, path, log), path, str(tmp_path / "bad"), lifecycle.Policy(), ["titulo"]) == "ok"
            again = pipeline.process_run(raw, request, table, state.read_log(spark, path, log), path, str(tmp_path / "bad"), lifecycle.Policy(), ["titulo"])
            assert again == "ya_registrado"
        got = {(r["portal"], r["enlace"]): r["ausencias_consecutivas"] for r in table.read().collect()}
        assert got == {("p", "h/1"): 0, ("p", "h/2"): 1, ("q", "h/1"): 0}
        versions = [table.part({"sector": "s", "portal": p, "tipo_operacion": "v"}).version() for p in ("p", "q")]
        assert versions == [2, 1] and [r["n_desaparecidos"] for r in state.read_log(spark, path, log).collect()] == [1, 0, 0]

    def test_an_unreadable_log_is_an_error(self, spark, tmp_path):
        (tmp_path / "log").mkdir()
        (tmp_path / "log" / "x.parquet").write_text("not a log")
        with pytest.raises(Exception):  # noqa: B017, PT011
            state.read_log(spark, str(tmp_path / "log"), StructType.fromDDL("corrida_id int")).collect()

    def test_plan(self):
        assert pipeline.planned_runs(["a", "b"], ["v", "w"]) == [("a", "v"), ("a", "w"), ("b", "v"), ("b", "w")]
        assert pipeline.planned_runs(["a", "b"], [], "b") == [("b", None)] and pipeline.planned_runs(["a"], ["v", "w"], operation="w") == [("a", "w")]


class TestState:
    def test_migration_and_schema(self, spark):
        old = spark.createDataFrame([("p", "h/1?x", at(1)), ("p", "h/1", at(2)), (None, None, None)], "portal string, enlace string, ultima_vez_visto timestamp_ntz")
        got = sorted(state.migrated_state(old, "s", "op", StructType.fromDDL("op string, activo boolean, extra int")).collect(), key=str)
        assert [(r["clave_registro"], r["ultima_vez_visto"], r["activo"], r["extra"]) for r in got] == [("s|p|op||h/1", at(2), True, None), ("s||op||", None, True, None)]
        assert [tuple(r) for r in state.repeated_keys(spark.createDataFrame([(None,), (None,), (1,)], "k int"), ["k"]).collect()] == [(None, 2)]

    def test_views(self, spark, tmp_path):
        rows = spark.createDataFrame([("s", "p", "v", True), ("s", "p", "w", False), ("t", "p", "v", True)], "sector string, portal string, op string, activo boolean")
        assert state.read_listings(rows, "s").count() == 2 and state.read_listings(rows, "s", "p", ("op", "w")).count() == 1
        assert state.read_listings(rows, "s", only_active=True, columns=["op", "zz"]).columns == ["op"]
        assert state.regenerate_view(rows.where("false"), str(tmp_path / "v")) is None and not (tmp_path / "v").exists()

    def test_sheets(self, spark):
        a, b = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "b"), (1, "c")], "id int, v string")
        sheet = accumulate.Sheet("x", ["id"])
        assert accumulate.accumulate_sheets({"x": a}, {"x": b}, [sheet])["x"].count() == 1
        assert accumulate.accumulate_sheets({"x": a.where("false")}, {"x": b}, [sheet])["x"].count() == 2  # nothing to merge with: stays as it is
        assert accumulate.accumulate_sheets({"x": a, "y": a}, {}, [sheet, accumulate.Sheet("z")]).keys() == {"x"}


@pytest.mark.parametrize("rows", [2, 3, 1000])
def test_asof_deals_out_hot_blocks(spark, rows):
    left = [(i, "a" if i % 4 else "b", datetime(2026, 1, 1, 0, i % 7, i % 5)) for i in range(60)] + [(90, "c", at(1)), (91, "a", None)]
    right = [("a" if i % 3 else "b", datetime(2026, 1, 1, 0, i % 9, i % 4), i) for i in range(40)] + [("b", datetime(2025, 1, 1), 99)]
    got = asof_backward(spark.createDataFrame(left, "id int, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, t timestamp_ntz, v int"), {"k": "k"}, ("t", "t"), {"v": "w"}, tie="v", rows_per_group=rows)
    want = {i: max(((t2, v) for k2, t2, v in right if k2 == k and t is not None and t2 <= t), default=(None, None))[1] for i, k, t in left}
    assert {r["id"]: r["w"] for r in got.collect()} == want and got.count() == len(left)


def test_numbers_are_dense_over_partitions(spark):
    df = spark.range(0, 5000, 7).select((F.col("id") * 13 % 5003).alias("k")).repartition(6)
    got = duplicates.dense_numbers(df, "k", "n").collect()
    order = sorted(r["k"] for r in got)
    assert all(order[r["n"] - 1] == r["k"] for r in got) and duplicates.dense_numbers(df.where("false"), "k", "n").isEmpty()


class TestPages:
    def find(self, spark, key, state_text, depth=30):
        return spark.createDataFrame([(state_text,)], "s string").select(embedded.find_key(key, depth)("s")).first()[0]

    def test_depth(self, spark):
        nest = lambda n: '{"x": ' * n + '{"k": 1}' + "}" * n
        assert self.find(spark, "k", nest(29)) == "1" and self.find(spark, "k", nest(30)) is None
        assert self.find(spark, "k", '[{"k": null, "a": {"k": 2}}, {"k": 3}]') == "3" and self.find(spark, "k", "no") is None and self.find(spark, "k", None) is None

    def test_found_keys_and_files(self, spark):
        got = spark.createDataFrame([('{"a": [{"b": null}], "c": {"b": 0}}',), ("x",), (None,)], "s string").select(embedded.found_keys(["b", "c", "z"])("s")).collect()
        assert [r[0] for r in got] == [{"b": "0", "c": '{"b": 0}'}, {}, {}]
        lists = spark.createDataFrame([('[{"archivo": "a"}, {"archivo": null}, {"b": 1}]',), ("nada",), (None,)], "s string")
        assert [len(r[0]) for r in lists.select(embedded.stored_files(F.col("s"))).collect()] == [1, 0, 0]

    def test_portal_with_pages(self):
        class Paged:
            fuente = "f"

            def pages(self, operation):
                return 2

            def discover_page(self, operation, n):
                return [portal.Reference(f"h/{n}{i}", "f", f"{n}{i}", operation) for i in range(2)]

            def detail(self, ref):
                return {"t": ref.id_externo}

        portal.register_portal("paged", Paged)
        reader = portal._Reader({"portal": "paged", "operacion": "venta"})
        assert [r[0] for p in reader.partitions() for r in reader.read(p)] == ["h/10", "h/11", "h/20", "h/21"]


class TestDocuments:
    def test_strategies(self, spark):
        def opener(content):
            words = [(0, 0, 10, 8, "a"), (40, 0, 50, 8, "b"), (0, 20, 10, 28, "c")]
            if content == b"bad":
                raise ValueError

            def grid():
                if content == b"plain":
                    raise AttributeError
                return SimpleNamespace(tables=[SimpleNamespace(extract=lambda: [["x ", None]])])

            return [SimpleNamespace(get_text=lambda kind: words, find_tables=grid)]

        files = spark.createDataFrame([("f", bytearray(b"ruled")), ("g", bytearray(b"plain")), ("h", bytearray(b"bad"))], "path string, content binary")
        rows = lambda how, **more: sorted((r["ruta"], r["fila"], tuple(r["celdas"]), r["metodo"]) for r in readers.document_tables(files, how, opener=opener, **more).collect())
        ruled, words = [("f", 0, ("x", ""), "lattice")], lambda f: [(f, 0, ("a", "b"), "stream"), (f, 1, ("c", ""), "stream")]
        assert rows("lattice") == ruled and rows("stream") == words("f") + words("g") and rows("auto") == ruled + words("g") and rows("auto", pages=[2]) == []
        with pytest.raises(ValueError, match="strategy"):
            documents.chosen_tables(None, None, ["p"], "other")

    def test_reference_or_none(self, spark):
        names = {"distrito": ["distrito", "zona"], "nse": ["nse"]}
        good = spark.createDataFrame([(0, "Título", None), (1, "  ZÓNA", "NSE"), (2, "a", "Alto"), (3, "b", None)], "_orden int, x string, y string")
        got = readers.reference_or_none(lambda: good, {"distrito": ["zona"], "nse": ["nse"]})
        assert [tuple(r) for r in got.collect()] == [("a", "Alto")]
        assert readers.reference_or_none(lambda: 1 / 0, names) is None and readers.reference_or_none(lambda: good.limit(0), names) is None


def test_names_with_signs_are_found_in_texts(spark):
    reference = spark.createDataFrame([(i, "lima", n, "Alto") for i, n in enumerate(["juan-pablo segundo", "juan-pablo segundo", "los a. rios", "los a. rios"])], "o int, distrito string, lugar string, nse string")
    rows = spark.createDataFrame([(1, "x juan-pablo segundo y"), (2, "xjuan-pablo segundo"), (3, "cerca a los a. rios"), (4, None), (5, "juan pablo segundo")], "id int, t string").withColumn("d", F.lit("lima"))
    got = {r["id"]: r["metodo"] for r in lookup.classify(rows, lookup.build_index(reference, "o"), "id", ["t"], "d").collect()}
    assert got == {1: "urbanizacion_texto", 2: None, 3: "urbanizacion_texto", 4: None, 5: None}


def test_rates_from_cache_alone_where_the_service_fails(spark):
    cache = spark.createDataFrame([(date(2026, 1, 5), 3.0, 4.0, 3.5)], "fecha date, compra double, venta double, promedio double")
    days = spark.createDataFrame([(at(4),), (at(6),), (at(6),), (None,)], "t timestamp_ntz")
    asked = []

    def service(first, last):
        asked.append((first, last))
        raise OSError("down")

    found, after = fx.rates_by_day(days, "t", cache, service, "s", "f", F.lit(at(9)).cast("timestamp_ntz"))
    assert asked == [(date(2025, 12, 25), date(2026, 1, 6))] and after.count() == 1
    assert sorted((r["dia"], r["venta"]) for r in found.collect()) == [(date(2026, 1, 4), None), (date(2026, 1, 6), 4.0)]
    assert fx.missing_range(days.where("false"), cache, "t").isEmpty()


def test_rounding_is_that_of_python(spark):
    values = [2.675, 0.125, 0.375, -2.675, -0.125, 1e15, 9921.825, 0.005, 0.015, 1e-9, 1e300] + [k / 7 for k in range(-300, 300)] + [k / 1000 for k in range(2000)]
    got = spark.createDataFrame([(x,) for x in values], "x double").select(numbers.round_binary(F.col("x"))).collect()
    assert [r[0] for r in got] == [round(x, 2) for x in values]


def test_blank_is_not_the_text_nan(spark):
    df = spark.createDataFrame([("NaN", float("nan")), (" ", 1.0), (None, None)], "t string, x double")
    assert [tuple(r) for r in df.select(text.is_blank(F.col("t")), text.is_blank(F.col("x")), text.or_null(F.col("x"))).collect()] == [(False, True, None), (True, False, 1.0), (True, True, None)]


def test_modules_that_nothing_imports(spark, tmp_path):
    package = tmp_path / "pkg"
    package.mkdir()
    for name, source in {"__init__": "from pkg import a", "a": "import os\nfrom pkg.b import f", "b": "x = (", "c": "", "main": "import other.c2"}.items():
        (package / f"{name}.py").write_text(source)
    got = {r[0] for r in modules.orphan_modules(modules.source_files(spark, str(tmp_path))).collect()}
    assert got == {"pkg.c", "pkg.main"}


def test_settings(monkeypatch, tmp_path):
    for value, number in ((" 7 ", 7), ("x", 3), ("", 3), ("7.5", 3)):
        monkeypatch.setenv("TABLON_N", value)
        assert config.env_number("TABLON_N", 3) == number
    monkeypatch.delenv("TABLON_N")
    assert config.env_number("TABLON_N", 2.5) == 2.5
    path = config.log_to_folder(str(tmp_path / "logs"), name="tablon.test")
    import logging

    logging.getLogger("tablon.test").warning("hola")
    assert "hola" in open(path).read() and os.path.dirname(path) == str(tmp_path / "logs")
