import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablon.operators import accumulate, documents, duplicates, embedded, enrich, fx, lifecycle, lookup, quality
from tablon.operators.asof import asof_backward

SCOPE = ["portal", "tipo_operacion"]
STATE = "portal string, tipo_operacion string, enlace string, titulo string, primera_vez_visto timestamp_ntz, ultima_vez_visto timestamp_ntz, ausencias_consecutivas int, activo boolean, fecha_baja date"


def at(day, hour=0):
    return datetime(2026, 1, day, hour)


class TestAsof:
    def rows(self, spark):
        left = spark.createDataFrame([(1, "a", at(1)), (2, "a", at(5)), (3, "a", None), (4, None, at(5)), (5, "b", at(9)), (5, "b", at(9))], "id int, k string, t timestamp_ntz")
        right = spark.createDataFrame([("a", at(2), 1), ("a", at(5), 2), ("a", at(5), 3), ("b", at(1), 4), (None, at(1), 5), ("b", None, 6)], "k string, t timestamp_ntz, v int")
        return left, right

    @pytest.mark.parametrize("width", [86400, 10 * 365 * 86400])
    def test_latest_before(self, spark, width):
        left, right = self.rows(spark)
        got = asof_backward(left, right, {"k": "k"}, ("t", "t"), {"v": "w"}, width_s=width).collect()
        assert sorted((r["id"], r["w"]) for r in got if r["w"]) == [(2, 3), (5, 4), (5, 4)] and len(got) == 6

    def test_empty(self, spark):
        left, right = self.rows(spark)
        assert asof_backward(left, right.limit(0), {"k": "k"}, ("t", "t"), {"v": "w"}).where("w is not null").isEmpty()
        assert asof_backward(left.limit(0), right, {"k": "k"}, ("t", "t"), {"v": "w"}).isEmpty()


class TestLifecycle:
    def run(self, spark, batches, policy=lifecycle.Policy(absences=2), runs=None):
        state = spark.createDataFrame([], STATE)
        for i, links in enumerate(batches):
            rows = spark.createDataFrame([("p", "v", e, f"t{n}", n) for n, e in enumerate(links)], "portal string, tipo_operacion string, enlace string, titulo string, __n int")
            run = (runs or {}).get(i, lifecycle.Run(at(i + 1)))
            state = lifecycle.apply_run(state.drop("estado_anuncio"), rows, run, policy, SCOPE, "__n")
        return {r["enlace"]: r for r in state.collect()}

    def test_new_repeated_missing_retired(self, spark):
        got = self.run(spark, [["h/1", "h/2"], ["h/1"], ["h/1"]])
        assert got["h/1"]["estado_anuncio"] == "repetido" and got["h/1"]["ausencias_consecutivas"] == 0
        assert (got["h/2"]["ausencias_consecutivas"], got["h/2"]["activo"], got["h/2"]["fecha_baja"]) == (2, False, at(3).date())

    def test_last_of_a_run_wins_and_links_are_canonical(self, spark):
        got = self.run(spark, [["h/1?a", "h/1#b", " ", None]])
        assert list(got) == ["h/1"] and got["h/1"]["titulo"] == "t1"

    def test_seen_again_is_active_again(self, spark):
        got = self.run(spark, [["h/1", "h/2"], ["h/1"], ["h/1"], ["h/1", "h/2"]])
        assert (got["h/2"]["estado_anuncio"], got["h/2"]["activo"], got["h/2"]["fecha_baja"]) == ("repetido", True, None)

    @pytest.mark.parametrize("run", [lifecycle.Run(at(2), quality="degradado"), lifecycle.Run(at(2), complete=False), lifecycle.Run(at(2), rerun=True)])
    def test_no_absences(self, spark, run):
        assert self.run(spark, [["h/1", "h/2"], ["h/1"]], runs={1: run})["h/2"]["ausencias_consecutivas"] == 0

    def test_collapse_guard(self, spark):
        policy = lifecycle.Policy(absences=1, collapse_base=10)
        got = self.run(spark, [[f"h/{i}" for i in range(20)], ["h/0"]], policy)
        assert all(r["activo"] for r in got.values()) and len(got) == 20

    def test_staleness(self, spark):
        runs = {1: lifecycle.Run(datetime(2026, 4, 1), complete=False)}
        got = self.run(spark, [["h/1", "h/2"], ["h/1"]], lifecycle.Policy(stale_days=30), runs)
        assert (got["h/2"]["activo"], got["h/2"]["ausencias_consecutivas"]) == (False, 0) and got["h/1"]["activo"]

    def test_all_runs_of_every_scope(self, spark, tmp_path):
        from tablon.plans.reference_queries import QUERIES

        many = [f"h/{i}" for i in range(20)]
        seen = {
            "p": [["h/1", "h/2", "h/3"], ["h/1", "h/2"], ["h/1", "h/2"], ["h/1"], ["h/1", "h/3"]],  # h/3 is retired by run 4 and comes back; h/2 is away twice
            "q": [["h/1", "h/2"], ["h/1"], ["h/1"], ["h/1"]],
            "r": [many, ["h/0"], many[:9], many[:9], many[:9]],  # run 2 is a collapse
            "s": [["h/1", "h/2"], ["h/1"], [], ["h/1"], ["h/1"]],  # run 2 is partial, run 3 delivers nothing, run 5 has run 4's source
        }
        runs, rows = [], []
        for k, (portal, lists) in enumerate(seen.items()):
            for n, links in enumerate(lists, 1):
                run = 10 * n + k  # scopes' runs alternate
                source = "s4" if (portal, n) == ("s", 5) else f"{portal}{n}"
                runs.append((run, at(n, k), portal, "v", source, (portal, n) != ("s", 2), "ok"))
                rows += [(run, portal, "v", e, f"t{n}", 1.0, at(n, k)) for e in links]
        spark.createDataFrame(runs, "corrida_id long, fecha timestamp_ntz, portal string, tipo_operacion string, id_fuente string, listado_completo boolean, estado_calidad string").write.parquet(f"{tmp_path}/corridas.parquet")
        spark.createDataFrame(rows, "corrida_id long, portal string, tipo_operacion string, enlace string, titulo string, precio double, recibido_en timestamp_ntz").write.parquet(f"{tmp_path}/fotos_anuncios.parquet")
        got = {(r["portal"], r["enlace"]): r for r in QUERIES["q_lifecycle_runs"](spark, str(tmp_path)).collect()}
        state = lambda *k: tuple(got[k][c] for c in ("ausencias_consecutivas", "activo", "fecha_baja", "estado_anuncio"))
        assert len(got) == 3 + 2 + 20 + 2
        assert state("p", "h/1") == (0, True, None, "repetido") and state("p", "h/3") == (0, True, None, "repetido")
        assert state("p", "h/2") == (2, True, None, None)
        assert state("q", "h/2") == (3, False, at(4).date(), None) and state("q", "h/1") == (0, True, None, "repetido")
        assert state("r", "h/8") == (0, True, None, "repetido") and state("r", "h/9") == (3, False, at(5).date(), None)
        assert state("s", "h/2") == (2, True, None, None) and state("s", "h/1") == (0, True, None, "repetido")
        assert (got["p", "h/3"]["primera_vez_visto"], got["p", "h/3"]["ultima_vez_visto"], got["p", "h/3"]["titulo"]) == (at(1), at(5), "t5")

    def test_known_run(self, spark):
        log = spark.createDataFrame([("x1", "p", None)], "id_fuente string, portal string, tipo_operacion string")
        assert lifecycle.known_run(log, "x1", {"portal": "p", "tipo_operacion": None})
        assert not lifecycle.known_run(log, "x1", {"portal": "q", "tipo_operacion": None})


def test_keep_last_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, o int")
    assert sorted(r["o"] for r in accumulate.keep_last(df, ["k"], [F.col("o")]).collect()) == [2, 3]


def test_accumulate_keeps_new_rows_and_all_columns(spark):
    old = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "b", 9), (2, "c", 8)], "id int, v string, extra int")
    got = accumulate.accumulate(old, new, ["id"])
    assert got.columns == ["id", "v", "extra"] and sorted(map(tuple, got.collect())) == [(1, "b", 9), (2, "c", 8)]
    assert accumulate.accumulate(None, new.union(new), ["id"]).count() == 4


def test_fill_and_pending(spark):
    rows = spark.createDataFrame([("k", " "), ("k", "x"), ("z", None)], "k string, v string")
    cache = spark.createDataFrame([("k", "c"), ("k", "b")], "k string, w string")
    assert sorted(str(r["v"]) for r in accumulate.fill_blank(rows, cache, ["k"], "w", "v").collect()) == ["None", "c", "x"]
    assert [r["k"] for r in accumulate.pending(rows, cache, ["k"], "v").collect()] == ["z"]


def test_gate(spark):
    df = spark.createDataFrame([("a", None), ("b", " "), (None, "x")], "x string, y string")
    gate = lambda d, least, s=None: quality.quality_gate(d, least, s).first()
    assert gate(df, {"x": 0.5})["estado"] == "ok"
    assert gate(df, {"y": 0.5}) ["motivos"] == ["Cobertura de 'y' 33.3% < umbral 50%"]
    assert gate(df, {"nada": 0.1})["estado"] == "degradado"
    assert gate(df, {"x": 0.5}, {"aviso": F.count("*") > 1})["estado"] == "advertencia"
    assert gate(df.limit(0), {"x": 0.5})["estado"] == "sin_datos"
    cov = {r["campo"]: (r["llenos"], r["pct"], r["presente"]) for r in quality.coverage(df, ["x", "nada"]).collect()}
    assert cov == {"x": (2, 0.6667, True), "nada": (0, 0.0, False)}


def test_fx(spark):
    rows = spark.createDataFrame([(1, at(3), 100.0, None, 10.0), (2, at(3), None, 10.0, 0.0), (3, at(3), 1.0, 1.0, None), (4, at(1), 5.0, None, None)], "id int, f timestamp_ntz, s double, u double, m2 double")
    rates = spark.createDataFrame([(at(2), 3.0, 4.0)], "fecha timestamp_ntz, compra double, venta double")
    got = {r["id"]: r for r in fx.convert_amounts(rows, rates, "f", "s", "u", "m2").collect()}
    assert got[1]["dolares_estimado"] == 25.0 and got[1]["imputado"] == ["u"] and got[1]["dolares_por_m2"] == 2.5
    assert got[2]["soles_estimado"] == 40.0 and got[2]["soles_por_m2"] is None and got[2]["s"] is None
    assert got[3]["imputado"] == [] and got[4]["tc"] is None and got[4]["dolares_estimado"] is None
    assert fx.convert_amounts(rows, rates, "f", "s", "u", mode="promedio").where("id = 2").first()["soles_estimado"] == 35.0
    with pytest.raises(ValueError):
        fx.convert_amounts(rows, rates, "f", "s", "u", mode="otro")


def test_lookup_cascade(spark):
    ref = spark.createDataFrame(
        [(1, "Uno", "Urb. Los Álamos", "alto"), (2, "Uno", "Los Alamos", "Alto"), (3, "Dos", "Los Alamos", "bajo"), (4, "Dos", "los alamos", "Bajo"), (5, "Dos", "Unico", "medio"), (6, None, "Los Alamos", "medio")],
        "o int, distrito string, lugar string, nse string",
    )
    index = lookup.build_index(ref, "o")
    rows = spark.createDataFrame(
        [(1, "Calle 5, Urb Los Alamos", "dos"), (2, "Los Alamos", "tres"), (3, "frente a los alamos grandes, x", "uno"), (4, "Unico", "dos"), (5, None, None)],
        "id int, t string, d string",
    )
    got = {r["id"]: (r["nse"], r["metodo"]) for r in lookup.classify(rows, index, "id", ["t"], "d").collect()}
    assert got[1] == ("Bajo", "urbanizacion_distrito")
    assert got[2] == ("Alto", "urbanizacion_global")  # a tie: the one that came first
    assert got[4] == (None, None) and got[5] == (None, None) and len(got) == 5


def test_lookup_with_an_area(spark):
    config = lookup.LookupConfig(("uno", "dos"), {"centro": "uno"}, least=1)
    ref = spark.createDataFrame([(1, "Centro", "Urb. Pinos Dos", "alto"), (2, "Dos", "Villa Sauce", "bajo")], "o int, distrito string, lugar string, nse string")
    index = lookup.build_index(ref, "o", config)
    rows = spark.createDataFrame([(1, "x, casa en urb Pinos Uno", "centro"), (2, "cerca de villa sauce y mas", "Uno"), (3, "Uno", "uno")], "id int, t string, d string")
    got = {r["id"]: (r["nombre"], r["metodo"]) for r in lookup.classify(rows, index, "id", ["t"], "d", config).collect()}
    assert got == {1: ("pinos", "urbanizacion_distrito"), 2: ("villa sauce", "urbanizacion_texto"), 3: (None, None)}


def test_duplicate_groups(spark):
    df = spark.createDataFrame(
        [(1, "Inmobiliaria Sol", "Casa con patio amplio", "z", 100.0), (2, "inmobiliaria sol", "casa amplio con patio", "z", 101.0), (3, "Inmobiliaria Sol", "casa con patio amplio", "otra", 100.0), (4, "", "x", "z", 1.0), (5, None, "x", "z", None)],
        "id int, e string, t string, r string, v double",
    )
    pairs = duplicates.similar_pairs(df, "id", "e", "t", "r", "v")
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]
    assert sorted(map(tuple, duplicates.duplicate_groups(pairs).collect())) == [(1, 1, 2), (2, 1, 2)]
    assert duplicates.duplicate_groups(pairs.limit(0)).isEmpty()


def signal(rows):
    """Pairs of (id, entity, title, region, value), every two rows compared as the reference does."""
    from difflib import SequenceMatcher

    norm = lambda x: " ".join(re.sub("[^a-z0-9 ]", " ", (x or "").lower()).split())
    sort = lambda x: " ".join(sorted(x.split()))
    key = lambda e: max([w for w in e.split() if len(w) >= 3] or e.split(), key=len)
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    rows = sorted((i, norm(e), sort(norm(t)), norm(r), v) for i, e, t, r, v in rows if norm(e) and norm(t))
    found = set()
    for n, (i, e, t, r, v) in enumerate(rows):
        for j, f, u, q, w in rows[n + 1 :]:
            if r == q and key(e) == key(f) and ratio(sort(e), sort(f)) >= 0.80:
                x, y = set(t.split()), set(u.split())
                shared = len(x & y) / min(len(x), len(y)) >= 0.60 and v and w and v > 0 and w > 0 and abs(v - w) <= 0.05 * max(v, w)
                if ratio(t, u) >= 0.82 or shared:
                    found.add((i, j))
    return found


def test_similar_pairs_are_those_of_all_rows(spark):
    draw = random.Random(5)
    words = ["casa", "cassa", "patio", "patios", "amplio", "sol", "vista", "mar"]
    rows = [
        (i, f"Corredora {draw.choice(['13', '15', '24', 'Sol', 'Sal'])}", " ".join(draw.choices(words, k=draw.randint(1, 4))), draw.choice("xy"), draw.choice([100.0, 103.0, 120.0, 0.0, None]))
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, "id int, e string, t string, r string, v double")
    got = [tuple(r) for r in duplicates.similar_pairs(df, "id", "e", "t", "r", "v").collect()]
    assert len(got) == len(set(got)) and set(got) == signal(rows)


def test_blocks_are_by_the_first_longest_word(spark):
    rows = [(1, "sol mar uno dos", "casa", "z", None), (2, "sol mal uno dos", "casa", "z", None), (3, "uno sol mar dos", "casa", "z", None), (4, "dos uno sol abc", "casa", "z", None), (5, "dos uno sol mar", "casa", "z", None)]
    df = spark.createDataFrame(rows, "id int, e string, t string, r string, v double")
    assert {tuple(r) for r in duplicates.similar_pairs(df, "id", "e", "t", "r", "v").collect()} == signal(rows) != set()


def test_groups_by_the_full_signal(spark, tmp_path):  # checks q_dup_signal_groups
    from tablon.plans.reference_queries import QUERIES

    draw = random.Random(6)
    rows = [
        (i, f"Brand#{draw.choice([13, 15, 24, 46])}", f"{draw.choice(['large', 'larger', 'small', 'red'])} {draw.choice(['ring', 'rings', 'bolt', 'plate', 'gizmo'])}", draw.choice("TUVWXYZ"), draw.choice([100.0, 103.0, 500.0]))
        for i in range(90)
    ]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string, p_type string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    root = list(range(90))
    for a, b in signal(rows):
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    roots = sorted({r for r in root if root.count(r) > 1})
    want = {(i, roots.index(r) + 1, root.count(r)) for i, r in enumerate(root) if r in roots}
    full = {tuple(r) for r in QUERIES["q_dup_signal_groups"](spark, str(tmp_path)).select("id", "dup_grupo", "miembros").collect()}
    reduced = {tuple(r) for r in QUERIES["q_dup_groups"](spark, str(tmp_path)).select("id", "dup_grupo", "miembros").collect()}
    assert full == want and len(roots) > 5 and full != reduced


def grouped(pairs):
    """``(id, group, members)`` of linked ids, groups in order of their least id."""
    root = {i: i for p in pairs for i in p}
    for a, b in pairs:
        x, y = sorted((root[a], root[b]))
        root = {i: x if r == y else r for i, r in root.items()}
    roots, sizes = sorted(set(root.values())), list(root.values())
    return {(i, roots.index(r) + 1, sizes.count(r)) for i, r in root.items()}


@pytest.mark.parametrize("seed", [7, 8])
def test_groups_are_those_of_all_pairs(spark, seed):
    """Texts that are alike in one order only, words that are repeated or shared by unlike titles, odd values, an id twice."""
    draw = random.Random(seed)
    names = ["Corredora ac caa", "corredora aaca cb", "Corredora abc ac", "corredora ca acc", "Corredora cab abb", "Corredora ac aaba"]
    titles = ["casa", "casa casa", "casa patio amplio vista mar", "amplio amplio saca", "amplio ola patio saca", "casa ola sol topia", "casa ola ola ola", "sol mar", "mar sol rojo azul verde"]
    values = [100.0, 95.0, 94.9, 105.3, 110.0, 120.0, 126.4, 0.0, -5.0, None, float("nan"), float("inf"), 1e-300]
    drawn = lambda i: (i, draw.choice(names), draw.choice(titles), draw.choice("UVWXYZ"), draw.choice(values))
    rows = [drawn(i) for i in draw.sample(range(1000), 70)]
    rows += [(rows[0][0], "Corredora zz", "otra cosa", "U", None), (2000, "corredora zz", "cosa otra", "u", None), (2001, "", "casa", "U", 1.0), (2002, "Corredora zz", None, "U", 1.0), (2003, "Corredora zz", "cosa otra", None, 1.0)]
    df = spark.createDataFrame([*rows, (None, "Corredora zz", "otra cosa", "U", None)], "id long, e string, t string, r string, v double")
    got = [tuple(r) for r in duplicates.similar_groups(df, "id", "e", "t", "r", "v").collect()]
    assert len(got) == len(set(got)) and set(got) == grouped({p for p in signal(rows) if p[0] < p[1]})
    pairs = duplicates.similar_pairs(df, "id", "e", "t", "r", "v", python=False)
    assert {tuple(r) for r in duplicates.similar_groups(df, "id", "e", "t", "r", "v", python=False).collect()} == grouped({tuple(r) for r in pairs.collect()})


def test_values_that_match_in_one_order_of_rows_only(spark):
    links = spark.createDataFrame([(1, 2, False), (3, 2, False), (2, 3, True), (1, 4, False), (1, 5, False), (6, 7, False), (8, 9, False)], "c1 long, c2 long, free boolean")
    # Rows 9 and 20 match 8 and 19 but come after them; 94 and 95 don't match 100.5, but row 30 matches row 33.
    values = [(9, 1, 95.0), (1, 1, 80.0), (8, 2, 100.0), (2, 2, 130.0), (10, 3, 104.0), (12, 4, float("inf")), (0, 5, float("inf")), (20, 6, 95.0), (21, 6, 94.0), (19, 7, 100.0), (22, 7, 100.5), (30, 8, 95.0), (31, 8, 94.0), (29, 9, 100.0), (33, 9, 99.2)]
    got = duplicates._matching_values(links, spark.createDataFrame(values, "id long, c long, v double"), 0.05)
    assert sorted(map(tuple, got.collect())) == [(1, 4), (2, 3), (8, 9)]


def linked_rows(monkeypatch, groups):
    """How many links were made for the groups, and these."""
    made, close = [0], duplicates.closure

    def counted(pairs, a, b):
        made[0] += pairs.count()
        return close(pairs, a, b)

    monkeypatch.setattr(duplicates, "closure", counted)
    return [tuple(r) for r in groups().collect()], made[0]


def test_copies_make_no_pairs_for_the_full_signal(spark, tmp_path, monkeypatch):
    from tablon.plans.reference_queries import QUERIES

    spark.range(3000).selectExpr("id p_partkey", "concat('Brand#1', id % 2) p_brand", "'large ring' p_name", "'T' p_type", "100.0D p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    got, made = linked_rows(monkeypatch, lambda: QUERIES["q_dup_signal_groups"](spark, str(tmp_path)))
    assert sorted(got) == [(i, 1, 3000) for i in range(3000)] and made <= 3000


def test_copies_make_no_pairs_for_equal_brands(spark, tmp_path, monkeypatch):
    from tablon.plans.reference_queries import QUERIES

    # Copies of one name, and of one that shares its words and some prices; another brand.
    name = "case id % 3 when 0 then 'large ring' when 1 then 'large large ring' else 'red bolt' end"
    spark.range(3000).selectExpr("id p_partkey", "if(id < 2990, 'Brand#1', 'Brand#2') p_brand", f"{name} p_name", "'T' p_type", "if(id % 2 = 0, 100.0D, 500.0D) p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    got, made = linked_rows(monkeypatch, lambda: QUERIES["q_dup_groups"](spark, str(tmp_path)))
    of = lambda brand, names: [i for i in range(3000) if (i < 2990) == (brand == 1) and (i % 3 < 2) == names]
    groups = sorted([of(1, True), of(1, False), of(2, True), of(2, False)])
    assert sorted(got) == sorted((i, n, len(g)) for n, g in enumerate(groups, 1) for i in g) and made <= 3000


def test_q_similarity_rates_all_parts(spark, tmp_path):  # checks q_similarity
    from tablon.plans.reference_queries import QUERIES

    # Copies; brands that are alike and ones that aren't; equal names in other price ranges.
    rows = [(1, "Brand#13", "large ring", "T", 100.0), (2, "Brand#13", "large ring", "T", 100.0), (3, "Brand#15", "large ring", "T", 500.0), (4, "Brand#24", "large ring", "T", 100.0), (5, "Brand#13", "large ring", "U", 100.0), (6, "Brand#15", "small ring", "T", 100.0)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string, p_type string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(r) for r in QUERIES["q_similarity"](spark, str(tmp_path)).collect()}
    assert got == signal(rows) and {(1, 2), (1, 3), (2, 3)} <= got


def test_closure_of_a_long_chain(spark):
    chain = spark.range(60).selectExpr("id + 100 as a", "id + 101 as b")
    assert {r["least"] for r in duplicates.closure(chain, "a", "b").collect()} == {100}


BOXES = "p int, x0 double, x1 double, y0 double, y1 double, texto string"


def test_tables(spark):
    words = spark.createDataFrame(
        [(1, 0.0, 10.0, 0.0, 10.0, "a"), (1, 11.0, 20.0, 1.0, 11.0, "b"), (1, 60.0, 80.0, 0.0, 10.0, "c"), (1, 0.0, 20.0, 20.0, 30.0, "d"), (2, 0.0, 5.0, 0.0, 9.0, "e")], BOXES
    )
    cuts = documents.column_cuts(words, ["p"])
    assert [(r["p"], r["corte"]) for r in cuts.collect()] == [(1, 40.5)]
    cells = documents.table_cells(documents.text_rows(words, ["p"]), cuts, ["p"])
    assert sorted((r["p"], r["fila"], r["celdas"]) for r in cells.collect()) == [(1, 0, ["a b", "c"]), (1, 1, ["d", ""]), (2, 0, ["e"])]
    assert documents.column_cuts(words.limit(0), ["p"]).isEmpty()


def test_notices(spark):
    pages = spark.createDataFrame([(1, "uno [A-1] [B-2] dos\n\n" + "x" * 700 + "\n\nfin [A-3] resto"), (2, None), (3, "")], "p int, texto string")
    got = documents.notices(pages, "texto", r"\[([A-Z]-\d)\]", r"^([A-Z])-").collect()
    assert [(r["codigo"], r["seccion"], r["aviso"]) for r in got] == [("A-1", "A", "uno"), ("A-3", "A", "fin")]
    assert documents.notices(pages, "texto", r"\[([A-Z]-\d)\]", r"^([A-Z])-", ["B"]).isEmpty()


def test_embedded(spark):
    html = '<script id="__NEXT_DATA__" type="application/json">{"b": [{"k": null}, {"k": 3}], "a": {"k": 4}}</script>'
    df = spark.createDataFrame([(html,), ('<script id="__NEXT_DATA__" type="application/json">{</script>',), (None,), ("x",)], "h string")
    state = embedded.page_state(F.col("h"))
    assert [r[0] is None for r in df.select(state).collect()] == [False, True, True, True]
    assert [r[0] for r in df.select(embedded.find_key("k")(state)).collect()] == ["3", None, None, None]


def test_enrich(spark):
    class Echo:
        def generate(self, prompt):
            import json

            rows = json.loads(prompt[prompt.index("[") :])
            return json.dumps({"r": [{"id": x["id"], "v": x["texto"].upper()} for x in rows if x["texto"] != "no"] + [7]})

    rows = spark.createDataFrame([("1", "h", "a", None), ("2", "h", "b", None), ("3", "h", "no", None)], "publicacion_id string, descripcion_hash string, texto string, valor string")
    cache = spark.createDataFrame([("1", "h", "C")], "publicacion_id string, descripcion_hash string, valor string")
    done, merged = enrich.enrich_with_cache(rows, cache, Echo(), "x", "v")
    assert {r["publicacion_id"]: r["valor"] for r in done.collect()} == {"1": "C", "2": "B", "3": None}
    assert merged.count() == 2
    assert enrich.answers_of("nada") == [] and enrich.answers_of('{"x": 1}') == []
