"""Operators of the llm subpackage against brute force and by hand."""

import itertools
import os
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablon.functions.identity import canonical_link
from tablon.llm import addresses, canonical, components, lookalikes, mixture, nearest, pairs, setjoin, tokens


class TestTokens:
    @pytest.fixture(scope="class")
    def encoder(self):
        return tokens.BytePairEncoder(tokens.read_vocabulary("byte_bpe_50k"))

    @pytest.fixture(scope="class")
    def library(self):
        import base64

        import tiktoken

        lines = tokens.read_vocabulary("byte_bpe_50k").splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @pytest.mark.parametrize("text", ["hola", " año\n\n  x", "<|endoftext|>", "a" * 3000, "😀👩‍👧é漢字", "\t \r\n", "ab" * 999 + "c", "'s've 123456"])
    def test_same_as_the_library(self, encoder, library, text):
        assert encoder.encode(text) == library.encode_ordinary(text)

    def test_random_texts(self, encoder, library):
        rng = np.random.default_rng(2)
        letters = list("aeioustrnlmABC é́ñ漢😀.,'0129<|>\n\t ")
        for _ in range(3000):
            text = "".join(rng.choice(letters, rng.integers(1, 40)))
            ids = encoder.encode(text)
            assert ids == library.encode_ordinary(text)
            assert library.decode(ids) == text

    def test_frames(self, spark):
        df = spark.createDataFrame([(1, "hola", "x"), (1, "hola", "x"), (2, "", "y"), (3, None, None)], "doc_id long, text string, c0 string")
        got = tokens.encode_texts(df)
        assert got.columns == ["doc_id", "text", "c0", "ids"]
        rows = sorted((r["doc_id"], r["ids"]) for r in got.collect())
        assert rows[0] == rows[1] and rows[2:] == [(2, []), (3, [])] and rows[0][1]
        assert [r["tokens"] for r in tokens.count_tokens(df).orderBy("doc_id").collect()] == [len(rows[0][1])] * 2 + [0, 0]
        assert tokens.encode_texts(df.limit(0)).isEmpty()


class TestComponents:
    def groups(self, spark, pairs):
        df = spark.createDataFrame(pairs, "a long, b long")
        return {r["vertex"]: r["component"] for r in components.connected_components(df, "a", "b").collect()}

    @pytest.mark.parametrize("seed", range(3))
    def test_random_graphs(self, spark, seed):
        rng = np.random.default_rng(seed)
        pairs = [tuple(map(int, rng.integers(0, 150, 2))) for _ in range(100)]
        root = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            if a != b:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        assert self.groups(spark, pairs) == {x: find(x) for x in root}

    def test_chain_and_star(self, spark):
        chain = [(i, i + 1) for i in range(40)]
        assert set(self.groups(spark, chain).values()) == {0}
        star = [(1000, i) for i in range(100)] + [(5, 1000), (1000, 5), (7, 7), (None, 1)]
        assert set(self.groups(spark, star).values()) == {0}

    def test_vertices_of_other_types(self, spark):
        df = spark.createDataFrame([("b", "z"), ("z", "a"), ("d", "c"), ("e", None), ("f", "f")], "a string, b string")
        got = {r["vertex"]: r["component"] for r in components.connected_components(df, "a", "b").collect()}
        assert got == {"a": "a", "b": "a", "z": "a", "c": "c", "d": "c"}

    def test_nothing(self, spark):
        assert self.groups(spark, []) == {} and self.groups(spark, [(1, 1), (None, 2)]) == {}

    def test_listing_groups(self, spark):
        listings = spark.createDataFrame([(9, "h/a?x"), (9, "h/a"), (4, "h/b"), (6, "h/c"), (7, None)], "anuncio_id long, enlace string")
        pairs = spark.createDataFrame([("h/a", "h/x#1", True), ("h/x", "h/b/", True), ("h/c", "h/a", None), ("h/c", "h/b", False), ("h/c", "h/c", True)], "enlace_a string, enlace_b string, aceptado boolean")
        got = components.listing_groups(listings, pairs, canonical_link)
        assert sorted(map(tuple, got.collect())) == [(4, 4), (9, 4)]  # through a link that no listing has


class TestNearest:
    def test_trie(self):
        rng = np.random.default_rng(5)
        for bits, n in ((10, 0), (10, 1), (12, 40), (20, 500)):
            values = np.unique(rng.integers(0, 1 << bits, n))
            queries = rng.integers(0, 1 << bits, 400)
            before, after = nearest.XFastTrie(values, bits).neighbours(queries)
            right = np.searchsorted(values, queries, "right") - 1
            left = np.searchsorted(values, queries, "left")
            assert (before == right).all() and (after == np.where(left == len(values), -1, left)).all()

    @pytest.mark.parametrize("rows", [7, 100_000])
    def test_against_brute_force(self, spark, rows):
        rng = np.random.default_rng(6)
        a = [(i, "xyz"[rng.integers(3)], int(rng.integers(0, 4 * 10**9))) for i in range(300)]
        b = [(i, "xyz"[rng.integers(2)], int(rng.integers(0, 4 * 10**9))) for i in range(60)]
        a += [(900, None, 5), (901, "x", None), (902, "x", b[0][2])]
        b += [(800, "x", None), (None, "x", 7), (801, b[0][1], b[0][2])]
        left, right = spark.createDataFrame(a, "id long, e string, us long"), spark.createDataFrame(b, "k long, e string, us long")
        got = nearest.nearest_in_time(left, right, ("id", "e", "us"), ("k", "e", "us"), 20, rows)
        want = []
        for i, e, t in a:
            near = sorted((abs(t - u), u, k) for k, f, u in b if None not in (k, u, e, t) and f == e and abs(t - u) <= 20_000_000)
            if near:
                want.append((i, near[0][2]))
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert nearest.nearest_in_time(left.limit(0), right, ("id", "e", "us"), ("k", "e", "us"), 20).isEmpty()
        assert nearest.nearest_in_time(left, right.limit(0), ("id", "e", "us"), ("k", "e", "us"), 20).isEmpty()


def test_instants_count_in_whole_seconds(spark, tmp_path):
    from datetime import datetime

    from tablon.llm.queries import p6_found

    listings = [(1, "p", "T", "2026-01-05T12:00:00.700Z"), (2, "p", "T", "2026-01-05T12:00:01Z"), (3, "p", None, "2026-01-05T12:00:00Z"), (1, "p", "T", "2026-01-05T12:00:00.700Z")]
    spark.createDataFrame(listings, "anuncio_id long, portal string, serie_tc string, fecha_publicacion string").write.parquet(f"{tmp_path}/anuncios.parquet")
    spark.createDataFrame([("p", "America/Lima", "DMA")], "portal string, zona_horaria string, orden_fecha string").write.parquet(f"{tmp_path}/portales.parquet")
    spark.createDataFrame([(7, "T", datetime(2026, 1, 5))], "tc_id long, series_codigos string, fecha timestamp_ntz").write.parquet(f"{tmp_path}/tipo_cambio_bcrp.parquet")
    assert [tuple(r) for r in p6_found(spark, str(tmp_path)).collect()] == [(1, 7)]


class TestSetJoin:
    @pytest.mark.parametrize("threshold", [0.25, 0.5, 0.8, 1.0])
    def test_against_brute_force(self, spark, threshold):
        rng = np.random.default_rng(8)
        make = lambda n: [(f"{n}{i}", sorted({f"t{int(x)}" for x in rng.zipf(1.5, rng.integers(0, 9)) if x < 40})) for i in range(60)]
        a, b = make("a"), make("b")
        schema = "id string, tokens array<string>"
        left, right = spark.createDataFrame([*a, (None, ["t1"])], schema), spark.createDataFrame(b, schema)
        want = {(i, j) for (i, x), (j, y) in itertools.product(a, b) if x and y and len({*x} & {*y}) / len({*x} | {*y}) >= threshold}
        for small in (0, 1000):  # shuffled, and broadcast
            got = setjoin.similarity_join(left, right, threshold, small).collect()
            assert {(r[0], r[1]) for r in got} == want and len(got) == len(want)

    def test_grams(self, spark):
        df = spark.createDataFrame([("aba",), ("a",), ("",), (None,)], "t string")
        assert [r[0] for r in df.select(setjoin.grams(F.col("t"))).collect()] == [["ab", "ba"], ["a"], [], []]


class TestCanonical:
    @pytest.fixture(scope="class")
    def lists(self, spark):
        entries = spark.createDataFrame([(1, "San Eladio", "Norte"), (2, "Santa Eladia", "Sur"), (3, "Río Turbio Alto", "Sur"), (4, "Río Turbio Bajo", "Sur"), (5, "Villa Tolmera", "Norte")], "distrito_id int, nombre string, provincia string")
        return entries, spark.createDataFrame([("el muelle", 5)], "alias_texto string, distrito_id int")

    @pytest.mark.parametrize(
        ("typed", "entry"),
        [
            ("san eladio", 1), ("Sta. Eladia", 2), ("S. Eladio", 1), ("SantaEladia,", 2), ("rio turbio bao", 4), ("Turbio Alto, Río", 3), ("Vlila Tolmra", 5), ("viya tolmera", 5),
            ("Distrito de Villa Tolmera", 5), ("Norte / Villa Tolmera", 5), ("EL MUELLE", 5), ("Villa Tolmera 15023", 5), ("Zona norte", -1), ("Otros", -1), ("??", -1), ("Lomas de Tarquinal", -1),
            ("x" * 3000, -1),
        ],
    )
    def test_values(self, spark, lists, typed, entry):
        listings = spark.createDataFrame([(7, typed, 0), (7, typed, 1), (8, None, 0), (9, "  ", 0)], "anuncio_id long, distrito string, distrito_id int")
        assert [tuple(r) for r in canonical.listings_entries(listings, *lists).collect()] == [(7, entry)]

    def test_empty_lists(self, spark, lists):
        listings = spark.createDataFrame([(7, "San Eladio")], "anuncio_id long, distrito string")
        assert [tuple(r) for r in canonical.listings_entries(listings, lists[0].limit(0), lists[1].limit(0)).collect()] == [(7, -1)]
        assert canonical.listings_entries(listings.limit(0), *lists).isEmpty()

    def test_edits(self):
        for a, b, n in [("abc", "acb", 1), ("abc", "abc", 0), ("", "ab", 2), ("casa", "cosas", 2), ("ca", "abc", 3)]:
            assert canonical._edits(a, b) == n
        rng = np.random.default_rng(4)
        texts = ["".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(600)]
        a, b = texts[:300], texts[300:]
        assert canonical.edit_counts(a, b).tolist() == [canonical._edits(x, y) for x, y in zip(a, b)]
        assert canonical.edit_counts([], []).tolist() == []


class TestLookalikes:
    def pairs(self, spark, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.lit(1))
        return sorted(map(tuple, lookalikes.lookalike_pairs(df).collect()))

    def test_pairs(self, spark):
        texts = [
            "Señor baño 5 m²", "Señor baño 5 m²", "Ｓeñor b­año 5 m²", "Señоr baño 5 m²", "Señor bano 5 m²", "Señor baño 5 m2", "señor baño 5 m²",
            "Señor baño 5 m²", None, "", " ", "​", "👩‍👧", "👩👧",
        ]
        same = [0, 1, 2, 3, 7]
        assert self.pairs(spark, texts) == [(a, b) for a, b in itertools.combinations(same, 2) if (a, b) != (0, 7)]

    def test_marks_in_any_order(self, spark):
        assert self.pairs(spark, ["q̣̇", "q̣̇", "ặ", "ặ", "ặ", "ặ"]) == [(0, 1), (2, 3), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5)]
        assert self.pairs(spark, ["á̀", "à́"]) == []  # of one class: the order shows

    def test_long_text_and_empty_table(self, spark):
        text = "ñandú " * 20_000
        assert self.pairs(spark, [text, unicodedata.normalize("NFD", text)]) == [(0, 1)]
        assert self.pairs(spark, []) == []

    def test_published_table(self, spark):
        assert self.pairs(spark, ["CASA", "ᏟASA", "ꓚASA", "casa", "lado", "Iado"]) == [(0, 1), (0, 2), (1, 2)]
        more = lookalikes.published_lookalikes(spark)
        assert len(more) > 60 and "l" not in more.values() and not set(more) & set(lookalikes.LOOKALIKES)

    def test_a_hot_form(self, spark):
        texts = ["a" + "\u200b" * i for i in range(40)]
        df = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string")
        want = list(itertools.combinations(range(40), 2))
        assert sorted(map(tuple, lookalikes.lookalike_pairs(df).collect())) == want
        groups = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 5), (None, 1), (None, 2), (3, None)], "g int, m int")
        assert sorted(map(tuple, pairs.member_pairs(groups, "g", "m", 7).collect())) == list(itertools.combinations(range(30), 2))

    def test_normal_form(self, spark):
        texts = ["Ｃafé №½", "a\r\nb\rc", "plain", "﻿х", None, "", "́x", "각"]
        df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "i int, text string, key string")
        got = {r["i"]: r["canon"] for r in lookalikes.normalise_lookalikes(df).collect()}
        assert got == {0: "Café №½", 1: "a\nb\nc", 2: "plain", 3: "x", 4: None, 5: "", 6: "́x", 7: "각"}

    def test_same_as_nfc_without_lookalikes(self, spark):
        rng = np.random.default_rng(9)
        letters = ["a", "e", "n", "é", "ñ", "ç", "ạ", "́", "̃", "̧", "̣", " ", "Z"]
        texts = ["".join(rng.choice(letters, 12)) for _ in range(300)]
        df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        for r in lookalikes.normalise_lookalikes(df).collect():
            assert r["canon"] == unicodedata.normalize("NFC", r["text"])


class TestMixture:
    def test_budgets(self):
        assert mixture.mixture_budgets({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 4}) == {"a": 40, "b": 40}
        assert mixture.mixture_budgets({"a": 100, "b": 0}, {"a": 0.3, "b": 0.7}, {"a": 2}) == {"a": 200}
        assert mixture.mixture_budgets({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 4}, 100) == {"b": 40, "a": 60}
        assert mixture.mixture_budgets({"a": 1}, {"a": 0.0}, {}) == {} and mixture.mixture_budgets({}, {"a": 1.0}, {}) == {}

    def test_temperature(self):
        import math

        sizes = {"a": 800, "b": 150, "c": 50, "d": 0}
        power, shares = mixture.temperature_shares(sizes, entropy=0.9)
        assert 0 < power < 1 and abs(-sum(q * math.log(q) for q in shares.values()) - 0.9) < 1e-6
        power, shares = mixture.temperature_shares(sizes, most={"a": 1, "b": 1, "c": 3}, total=1000)
        assert all(shares[s] * 1000 <= m * sizes[s] * (1 + 1e-9) for s, m in {"a": 1, "b": 1, "c": 3}.items())
        assert mixture.temperature_shares({}) == (1.0, {})

    def test_given_weights_are_the_mixture_until_a_limit(self):
        sizes, weights, most = {"a": 900, "b": 90, "c": 10, "d": 0}, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.4}, {"a": 1, "b": 2, "c": 3}
        power, budgets = mixture.tempered_budgets(sizes, weights, most)
        assert power == 0 and budgets == pytest.approx({"a": 75, "b": 45, "c": 30})
        power, budgets = mixture.tempered_budgets(sizes, weights, most, 600)
        assert 0 < power < 1 and sum(budgets.values()) == pytest.approx(600) and all(budgets[s] <= most[s] * sizes[s] * (1 + 1e-9) for s in budgets)
        assert mixture.tempered_budgets(sizes, weights, most, 10**6)[1] == pytest.approx({"a": 900, "b": 180, "c": 30})
        assert mixture.tempered_budgets({}, weights, most) == (1.0, {})
        power, budgets = mixture.tempered_budgets(sizes, weights, most, None, 0.8)
        shares = [x / sum(budgets.values()) for x in budgets.values()]
        import math

        assert -sum(x * math.log(x) for x in shares) == pytest.approx(0.8) and max(budgets[s] / sizes[s] / most[s] for s in budgets) == pytest.approx(1)

    def test_realised(self, spark):
        docs = [(i, "a", 10) for i in range(4000)] + [(9000 + i, "b", 7) for i in range(300)] + [(9900, None, 5), (9901, "z", 5), (9902, "b", 0)]
        df = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
        targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3), ("c", 0.0, 1)], "source string, peso_objetivo double, max_repeticiones int")
        mixed, report = mixture.mix_sources(df, targets)
        rows = mixed.collect()
        assert len({(r["doc_id"], r["copia"]) for r in rows}) == len(rows)
        by = {r["source"]: r for r in report.collect()}
        assert abs(by["b"]["participacion"] - 0.4) < 0.002 and by["b"]["copias"] == 3 and by["c"]["tokens_mezcla"] == 0
        copies = {}
        for r in rows:
            copies.setdefault(r["doc_id"], set()).add(r["copia"])
        assert all(c == set(range(1, len(c) + 1)) for c in copies.values())
        assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, rows))  # the seed decides

    def test_empty(self, spark):
        df = spark.createDataFrame([], "doc_id long, source string, tokens long")
        targets = spark.createDataFrame([("a", 1.0, 1)], "source string, peso_objetivo double, max_repeticiones int")
        mixed, report = mixture.mix_sources(df, targets)
        assert mixed.isEmpty() and report.count() == 1


class TestAddresses:
    @pytest.mark.parametrize(
        ("text", "number", "block", "words"),
        [
            ("Jr. Girasoles de las Nieves #7231, Los Granados", "7231", "", ["girasoles", "nieves"]), ("844 CA. CANDILEJAS D. MIRADOR", "844", "", ["candilejas", "mirador"]),
            ("Puente Ladrillo 5916 AV Huarangos Tórtolas Dpto. 206", "5916", "", ["huarangos", "tortolas"]),
            ("Calle Graneros d/l Hojarasca Nro. 3171 Dpto. 308", "3171", "", ["graneros", "hojarasca"]), ("Urb. La Noria, Mz. O Lt. 29", "", "o", ["noria"]),
            ("av Relicario de la Botella Nº567 Urb. La Tinaja Norte", "567", "", ["relicario", "botella"]), ("Manzana J46 Lote 74; Urb Los Ficus II Etapa", "", "j46", ["ficus", "ii", "etapa"]),
            ("Av. Los Olivos 5, Lince", "5", "", ["olivos"]), ("Jr. Lima 1234B", "1234b", "", ["lima"]), ("Jr. Lima 123-A, Lince", "123a", "", ["lima"]), ("Jr. Lima Nº 12345678", "12345678", "", ["lima"]),
            ("5213 C/ Mercaderes", "5213", "", ["mercaderes"]), ("Jr. Lima 450 - Lince", "450", "", ["lima"]), ("Jr. Lima 450 piso 3", "450", "", ["lima"]),
        ],
    )
    def test_parts(self, text, number, block, words):
        got = addresses.parse_address(text)
        assert (got["number"], got["block"], got["words"]) == (number, block, words)

    @pytest.mark.parametrize("text", [None, "", " ", "ver fotos", "A 5 min. del paradero", "frente a la casa 20", "a una cuadra del parque", "x" * 20_000])
    def test_no_place(self, text):
        assert addresses.parse_address(text) is None

    def test_pairs(self, spark):
        entries = spark.createDataFrame([(1, "Villa Tolmera", "N"), (2, "Campo Ferial", "N"), (3, "San Eladio", "S")], "distrito_id int, nombre string, provincia string")
        aliases = spark.createDataFrame([], "alias_texto string, distrito_id int")
        other = [(100 + i, f"Calle {a} del {b} {i + 200}, Campo Ferial", None) for i, (a, b) in enumerate(itertools.product(["Girasoles", "Tejedores", "Nogales"], ["Mirador", "Cuartel", "Estanque"] * 2))]
        rows = [
            (1, "Calle Girasoles del Mirador 123, Villa Tolmera", None), (2, "123 C/ Girasoles Mirador", "villa tolmera"), (3, "Jr Girasloes d. Mirador Nº123 Dpto. 5; V. Tolmera", "x"),
            (4, "Girasoles del Mirador num. 123", "Campo Ferial"), (5, "Villa Tolmera Girasoles del Mirador 124", None), (6, "Mz. B Lt. 5, Urb. Los Ficus I Etapa", "San Eladio"),
            (7, "URB LOS FICUS I ETAPA / MANZANA B LOTE 5 / SAN ELADIO", None), (8, "Mz B Lote 5 Urb. Los Ficus II Etapa, San Eladio", None), (9, None, "San Eladio"), (10, "ver mapa", "San Eladio"),
            (1, "Calle Girasoles del Mirador 123, Villa Tolmera", None),
        ]
        df = spark.createDataFrame(rows + other, "anuncio_id long, ubicacion string, distrito string").withColumn("id", F.lit(1))
        got = sorted(map(tuple, addresses.same_address_pairs(df, entries, aliases).collect()))
        assert got == [(1, 2), (1, 3), (2, 3), (6, 7)]
        assert addresses.same_address_pairs(df.limit(0), entries, aliases).isEmpty()

    def test_a_misspelling_is_told_by_other_numbers(self, spark):
        names = [(1, "s", "rio ene sur")] * 9 + [(1, "s", "rio ane zur"), (2, "s", "rio ano sur"), (1, "e", "rio one sur"), (1, "s", "lago i etapa")] + [(1, "s", "lago ii etapa")] * 9
        got = {(r["locality"], r["kind"], r["name"]): (r["entry"], r["n"]) for r in addresses.gazetteer(spark.createDataFrame(names, "locality long, kind string, name string")).collect()}
        assert got[1, "s", "rio ane zur"] == got[1, "s", "rio ene sur"] == ("rio ene sur", 10)
        assert got[2, "s", "rio ano sur"] == ("rio ano sur", 1) and got[1, "e", "rio one sur"] == ("rio one sur", 1) and got[1, "s", "lago i etapa"] == ("lago i etapa", 1)

    def test_short_localities_aliases_and_long_names(self, spark):
        entries = spark.createDataFrame([(1, "Ate", "L"), (2, "Surco", "L"), (3, "Miraflores", "L")], "distrito_id int, nombre string, provincia string")
        aliases = spark.createDataFrame([("santiago viejo", 2), (None, 3)], "alias_texto string, distrito_id int")
        long = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece"
        rows = [(1, "Jr. Lima 123, Ate", None), (2, "Jr. Lima 123, Surco", None), (3, "Jr. Lima 123", "surco"), (4, "Jr. Lima 123, Santiago Viejo", None), (5, "Jr. Lima 123-A, Ate", None), (6, "Jr. Lima 123A; ATE", None),
                (7, f"Jr. {long} 55, Ate", None), (8, f"Jr. otro {long} 55, Ate", None), (9, f"Jr. {long} 55 - Ate", None)]
        df = spark.createDataFrame(rows, "anuncio_id long, ubicacion string, distrito string")
        assert sorted(map(tuple, addresses.same_address_pairs(df, entries, aliases).collect())) == [(2, 3), (2, 4), (3, 4), (5, 6), (7, 8), (7, 9), (8, 9)]


def test_checkpoints_go_to_the_session_folder(spark):
    spark.range(1)
    components.connected_components(spark.createDataFrame([(1, 2)], "a long, b long"), "a", "b")
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    assert not any("localCheckpoint" in open(os.path.join(d, f)).read() for d, _, fs in os.walk(os.path.dirname(addresses.__file__)) for f in fs if f.endswith(".py"))


def test_spellings_meet_without_a_common_word(spark):
    rows = [(1, 5, "marañon", "120"), (2, 5, "marañoz", "120"), (3, 5, "rio ene sur", "7"), (4, 5, "rio ane zur", "7"), (5, 6, "maraňoz", "120")]
    resolved = spark.createDataFrame(rows, "id long, locality long, name string, place string")
    got = {r["id"]: r["place_id"] for r in addresses.place_ids(resolved).collect()}
    assert got[1] == got[2] != got[5] and got[3] == got[4]
