"""Units, instants and snapshots."""

from datetime import datetime
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablon.operators import instants, snapshots, units


class TestUnits:
    def test_compositions(self):
        graph = units.UnitGraph([units.affine("C", "K", 1, "273.15"), units.affine("F", "C", Fraction(5, 9), Fraction(-160, 9)), units.reciprocal("1/K", "K")])
        a, b, c, d = graph.to("K")["F"]
        assert float((a * 212 + b) / (c * 212 + d)) == pytest.approx(373.15)
        a, b, c, d = graph.to("K")["1/K"]
        assert float((a * 4 + b) / (c * 4 + d)) == 0.25

    def test_cycles_must_agree(self):
        units.UnitGraph([units.affine("a", "b", 10), units.affine("b", "c", 10), units.affine("a", "c", 100)]).to("c")
        with pytest.raises(ValueError):
            units.UnitGraph([units.affine("a", "b", 10), units.affine("b", "c", 10), units.affine("a", "c", 99)]).to("c")
        with pytest.raises(ValueError):
            units.UnitGraph([units.affine("a", "b", 0)])

    def test_the_money_graph_is_consistent(self):
        graph = units.money_graph()
        for money in units.FOREIGN:
            assert len(graph.to(f"uno PEN por uno {money}")) == 32

    def test_unknown_units_and_clashing_columns(self, spark):
        table = units.UnitGraph([units.affine("kg", "g", 1000), units.reciprocal("1/g", "g")]).table(spark, ["g"])
        df = spark.createDataFrame([(2.5, "kg", 1), (None, "kg", 2), (1.0, "??", 3), (1.0, None, 4), (0.0, "1/g", 5)], "v double, u string, unit int")
        got = {r["unit"]: r["x"] for r in units.convert(df, table, "v", "u", "x", "xu").collect()}
        assert {k: v and float(v) for k, v in got.items()} == {1: 2500.0, 2: None, 3: None, 4: None, 5: None}

    @pytest.mark.parametrize(
        ("price", "money", "soles"),
        [
            ("S/. 614 mil", None, 614000), ("55'400 USD", None, 207750), ("1.234,56", "soles", 1235), ("1,234.50", "S/", 1235), ("12.5k", "PEN", 12500),
            ("2.5", "S/ (miles)", 2500), ("40000", "centavos US$", 1500), ("$ 1", "n/d", 4), ("1 234 567", "sol", 1234567), ("1,39 MM", "soles", 1390000),
            ("doscientos mil soles", None, 200000), ("Ciento veinte mil", "sol", 120000), ("un millón doscientos mil soles", None, 1200000),
            ("Consultar", "S/", None), ("500", None, None), ("500", "n/d", None), (None, "S/", None), ("", "", None), ("S/ 0.5", None, 1),
            ("S/ 2.500", None, 2500), ("S/ 1234.5", None, 1235), ("9" * 30 + " soles", None, None), ("x " * 5000 + "S/ 7", None, 7),
        ],
    )
    def test_stated_amounts(self, spark, price, money, soles):
        listings = spark.createDataFrame([(1, price, money, "T", 1, 5), (1, price, money, "T", 1, 6)], "anuncio_id long, precio string, moneda string, serie_tc string, corrida_id long, unit int")
        runs = spark.createDataFrame([(1, datetime(2026, 1, 5))], "corrida_id long, fecha timestamp_ntz")
        quotes = spark.createDataFrame(
            [(1, "T", datetime(2026, 1, 1), 3.0, "PEN por USD", None), (2, "T", datetime(2026, 1, 5), 375.0, None, "valores en céntimos por US$"), (3, "T", datetime(2026, 1, 6), 9.0, "S/ por US$", None)],
            "tc_id long, series_codigos string, fecha timestamp_ntz, venta double, unidad string, nota string",
        )
        got = [tuple(r) for r in units.amounts_in_soles(listings, runs, quotes).collect()]
        assert got == ([(1, soles)] if soles is not None else [])

    @pytest.mark.parametrize(
        ("price", "money", "soles"),
        [
            ("1.200.000.000", "S/", 1200000000), ("CLP 1200 MM", None, 4800000), ("CLP 1.050.900.000", None, 4203600),
            ("2.000.000.000", "céntimos de sol", 20000000), ("999.999.999.999", "S/ (millones)", 999999999999000000), ("un millón de millones", "soles", 10**12),
            ("9.000.000.000.000.000.000", "S/", 9 * 10**18), ("99.000.000.000.000.000.000", "S/", None), ("99.000.000.000.000.000.000", "céntimos de sol", 99 * 10**16),
            ("CLP 12.345.678.901.234.567.890", None, 49382715604938272), (" ".join(["millones"] * 9), "soles", None), ("mil " * 900, "soles", 900_000),
        ],
    )
    def test_large_amounts(self, spark, price, money, soles):
        listings = spark.createDataFrame([(1, price, money, "T", 1)], "anuncio_id long, precio string, moneda string, serie_tc string, corrida_id long")
        runs = spark.createDataFrame([(1, datetime(2026, 1, 5))], "corrida_id long, fecha timestamp_ntz")
        quotes = spark.createDataFrame([(1, "T", datetime(2026, 1, 1), 4.0, "PEN por 1,000 CLP", None)], "tc_id long, series_codigos string, fecha timestamp_ntz, venta double, unidad string, nota string")
        got = [tuple(r) for r in units.amounts_in_soles(listings, runs, quotes).collect()]
        assert got == ([(1, soles)] if soles is not None else [])

    def test_large_values_convert(self, spark):
        table = units.UnitGraph([units.affine("kg", "g", 1000), units.reciprocal("1/g", "g")]).table(spark, ["g"])
        df = spark.createDataFrame([(5e11, "kg"), (2e9, "1/g"), (0.004, "1/g")], "v double, u string")
        assert [float(r["x"]) for r in units.convert(df, table, "v", "u", "x", "xu").collect()] == [5e14, 5e-10, 250.0]

    def test_conversions_are_exact(self, spark):
        fahrenheit = units.affine("F", "C", Fraction(5, 9), Fraction(-160, 9))
        table = units.UnitGraph([fahrenheit, units.affine("C", "K", 1, "273.15"), units.affine("nm", "m", Fraction(1, 10**9))]).table(spark, ["C", "m"])
        df = spark.createDataFrame([(212.0, "F"), (310.15, "K"), (-40.0, "F"), (7.0, "nm"), (float("nan"), "F"), (1e40, "F")], "v double, u string")
        got = [r["x"] and str(r["x"].normalize()) for r in units.convert(df, table, "v", "u", "x", "xu").collect()]
        assert got == ["1E+2", "37", "-4E+1", "7E-9", None, None]

    def test_halves_are_told_exactly(self, spark):
        from decimal import Decimal

        cases = [("1234567890123456.5", "1"), ("0.5", "1"), ("0.499999", "1"), ("3", "0.166666667"), ("1", "2.499999999"), ("0.1", "5")]
        df = spark.createDataFrame([(Decimal(a), Decimal(b)) for a, b in cases], "a decimal(38,9), b decimal(38,9)")
        one = F.lit(1).cast("decimal(38,9)")
        got = [r[0] for r in df.select(units.rounded_product((F.col("a"), one), (F.col("b"), one))).collect()]
        assert got == [int(Fraction(a) * Fraction(b) + Fraction(1, 2)) for a, b in cases]

    def test_rate_units(self, spark):
        said = ["PEN por 1,000 CLP", "céntimos por R$", "USD por 1 PEN", "soles por mil pesos chilenos", "S/. x €", "dólar por sol", "algo", None]
        df = spark.createDataFrame([(t,) for t in said], "t string")
        assert [r[0] for r in df.select(units.rate_unit(F.col("t"))).collect()] == [
            "uno PEN por mil CLP", "centi PEN por uno BRL", "uno USD por uno PEN", "uno PEN por mil CLP", "uno PEN por uno EUR", "uno USD por uno PEN", None, None,
        ]

    def test_no_rows(self, spark):
        listings = spark.createDataFrame([], "anuncio_id long, precio string, moneda string, serie_tc string, corrida_id long")
        runs = spark.createDataFrame([], "corrida_id long, fecha timestamp_ntz")
        quotes = spark.createDataFrame([], "tc_id long, series_codigos string, fecha timestamp_ntz, venta double, unidad string, nota string")
        assert units.amounts_in_soles(listings, runs, quotes).isEmpty()


def seconds(text, zone="America/Lima", order="DMA"):
    value, valid = instants.parse_instants([text], [zone], [order])
    return int(value[0] // 1_000_000) if valid[0] else None


def utc(*args):
    return int((datetime(*args) - datetime(1970, 1, 1)).total_seconds())


def test_long_texts_are_tried():
    long = "miércoles, 17 de setiembre de 2025, 03:04:05." + "123456789" * 4 + " p. m. -05:00 [America/Argentina/Buenos_Aires]"
    assert len(long) > 80 and seconds(long) == seconds("2025-09-17 15:04:05 -05:00") is not None
    assert seconds("17 de setiembre de 2025" + " y más" * 50_000) is None and seconds("2025-09-17 15:04 aa" + "_a" * 5_000 + "!") is None


class TestInstants:
    @pytest.mark.parametrize(
        ("text", "at"),
        [
            ("2024-03-05 10:00:00", utc(2024, 3, 5, 15)), ("2024-03-05T10:00:00Z", utc(2024, 3, 5, 10)), ("2024-03-05", utc(2024, 3, 5, 5)),
            ("20240305T100000-0500", utc(2024, 3, 5, 15)), ("05/03/2024 10:00", utc(2024, 3, 5, 15)), ("5/3/24 10:00", utc(2024, 3, 5, 15)),
            ("05.03.2024 10.00 h", utc(2024, 3, 5, 15)), ("5 de marzo de 2024, 1:05 p. m.", utc(2024, 3, 5, 18, 5)), ("05/03/2024 12:57 a. m.", utc(2024, 3, 5, 5, 57)),
            ("Setiembre 5, 2024 10:00:01", utc(2024, 9, 5, 15, 0, 1)), ("16 SET 2023, 14:35", utc(2023, 9, 16, 19, 35)), ("Thu, 01 May 2025 03:02:20 -0500", utc(2025, 5, 1, 8, 2, 20)),
            ("1727330306", 1727330306), ("1739602323162", 1739602323), ("2024-03-05T10:00:00.999999+05:30", utc(2024, 3, 5, 4, 30)),
            ("2024-03-05 10:00:00 PET", utc(2024, 3, 5, 15)), ("2024-03-05 10:00:00 [Europe/Madrid]", utc(2024, 3, 5, 9)), ("24/05/2024 09:02:22 GMT-5", utc(2024, 5, 24, 14, 2, 22)),
            ("  2024-03-05   10:00:00 ", utc(2024, 3, 5, 15)), ("2024-10-27T02:44:51+01:00[Europe/Madrid]", utc(2024, 10, 27, 1, 44, 51)),
            ("31/02/2024 10:00", None), ("0000-00-00", None), ("2024-13-45 08:00:00", None), ("2023-02-29", None), ("ayer", None), ("", None), (None, None), ("9" * 5000, None),
            ("2024-03-05 10:00:00 XYZ", None), ("2024-03-05 25:00", None),
        ],
    )
    def test_forms(self, text, at):
        assert seconds(text) == at

    def test_order_of_figures_and_unknown_sources(self):
        assert seconds("03/05/2024", order="MDA") == utc(2024, 3, 5, 5)
        assert seconds("03/05/2024", order=None) is None
        assert seconds("2024-03-05", zone=None) is None
        assert seconds("2024-03-05T00:00Z", zone=None, order=None) == utc(2024, 3, 5)
        assert seconds("2024-03-05", zone="No/Zone") is None

    def test_abbreviations_are_those_of_the_zone(self):
        assert seconds("2024-03-05 10:00:00 CST", "Asia/Shanghai") == utc(2024, 3, 5, 2)
        assert seconds("2024-03-05 10:00:00 CST", "America/Chicago") == utc(2024, 3, 5, 16)
        assert seconds("2024-03-05 10:00:00 CST", "America/Lima") is None  # means several things
        assert seconds("2024-07-05 10:00:00 CLT", "America/Santiago") == utc(2024, 7, 5, 14) == seconds("2024-07-05 10:00:00 CLT", None)
        assert seconds("2024-07-05 10:00:00 EST", "America/New_York") == utc(2024, 7, 5, 15)

    def test_years_beyond_the_tables(self):
        assert seconds("2150-07-01 12:00:00", "America/New_York") == utc(2150, 7, 1, 16)
        assert seconds("1850-07-01 12:00:00", "America/New_York") == utc(1850, 7, 1, 16, 56, 2)

    def test_changes_of_the_clock(self):
        assert seconds("2024-10-27 02:30:00", "Europe/Madrid") == utc(2024, 10, 27, 0, 30)  # occurs twice: the first
        assert seconds("2024-03-31 02:30:00", "Europe/Madrid") == utc(2024, 3, 31, 1, 30)  # is skipped
        assert seconds("2023-11-05 01:33:56", "America/New_York") == utc(2023, 11, 5, 5, 33, 56)

    def test_tables_agree_with_zoneinfo(self):
        from datetime import timedelta
        from zoneinfo import ZoneInfo

        rng = np.random.default_rng(1)
        for zone in ("America/Santiago", "Europe/Madrid", "America/New_York", "America/Lima"):
            local = rng.integers(0, utc(2060, 1, 1), 2000)
            got = instants.zone_table(zone).to_utc(local)
            for x, y in zip(local, got):
                here = (datetime(1970, 1, 1) + timedelta(seconds=int(x))).replace(tzinfo=ZoneInfo(zone))
                assert int(y) == int(here.timestamp())

    def test_frames(self, spark):
        rows = [(1, "p", "2024-03-05", None), (1, "p", "2024-03-05", None), (2, None, "2024-03-05T00:00Z", "x"), (3, "q", None, "2024-03-05")]
        listings = spark.createDataFrame(rows, "anuncio_id long, portal string, a string, b string").withColumn("zona_horaria", F.lit("clash"))
        portals = spark.createDataFrame([("p", "America/Lima", "DMA")], "portal string, zona_horaria string, orden_fecha string")
        got = sorted(map(tuple, instants.stated_instants(listings, portals, ["a", "b"]).collect()))
        assert got == [(1, "a", utc(2024, 3, 5, 5)), (2, "a", utc(2024, 3, 5))]
        assert instants.stated_instants(listings.limit(0), portals, ["a", "b"]).isEmpty()


ROWS = "corrida_id long, portal string, tipo_operacion string, enlace string, titulo string, precio double, recibido_en timestamp_ntz"


class TestSnapshots:
    def diff(self, spark, rows, runs, **more):
        table = spark.createDataFrame([(*r, datetime(2026, 1, 1, i % 24)) for i, r in enumerate(rows)], ROWS)
        log = spark.createDataFrame([(i, s, "v", datetime(2026, 1, t)) for i, s, t in runs], "corrida_id long, portal string, tipo_operacion string, fecha timestamp_ntz")
        got = snapshots.snapshot_differences(table, log, F.col("enlace"), ["titulo", "precio"], **more)
        return sorted(map(tuple, got.collect()))

    def test_kinds(self, spark):
        rows = [
            (1, "p", "v", "a", "t", 1.0), (1, "p", "v", "b", None, 1.0), (1, "p", "v", "c", "t", None), (2, "p", "v", "a", "t", 2.0), (2, "p", "v", "b", None, 1.0),
            (2, "p", "v", "d", "t", 1.0), (2, "p", "v", "d", "t", 1.0), (9, "q", "v", "a", "t", 1.0), (4, "p", "v", None, "t", 1.0), (3, "p", "v", "a", None, 2.0),
        ]
        # Run 4 has no key that counts, 7 no rows; 3 comes after 2 in time, and 77 isn't in the log.
        runs = [(2, "p", 5), (1, "p", 2), (3, "p", 9), (7, "p", 7), (9, "q", 1)]
        for buckets in (1, 7):
            assert self.diff(spark, [*rows, (77, "p", "v", "z", "t", 1.0)], runs, buckets=buckets) == [
                (2, "a", "cambio"), (2, "c", "baja"), (2, "d", "alta"), (3, "a", "cambio"), (3, "b", "baja"), (3, "d", "baja"),
            ]

    def test_null_and_empty_differ(self, spark):
        rows = [(1, "p", "v", "a", None, None), (2, "p", "v", "a", "", None)]
        assert self.diff(spark, rows, [(1, "p", 1), (2, "p", 2)]) == [(2, "a", "cambio")]

    def test_last_received_of_a_repeated_key_counts(self, spark):
        rows = [(1, "p", "v", "a", "x", 1.0), (2, "p", "v", "a", "y", 1.0), (2, "p", "v", "a", "x", 1.0)]
        assert self.diff(spark, rows, [(1, "p", 1), (2, "p", 2)]) == []

    def test_empty(self, spark):
        assert self.diff(spark, [], []) == []

    def test_against_brute_force(self, spark):
        rng = np.random.default_rng(3)
        rows = [(int(r), "p" if r < 5 else "q", "v", f"k{rng.integers(40)}", str(rng.integers(3)), None) for r in range(10) for _ in range(25)]
        seen = {}
        for i, r in enumerate(rows):
            rows[i] = r = (*r[:4], seen.setdefault((r[0], r[3]), r[4]), None)
        want = []
        for n in [1, 2, 3, 4, 6, 7, 8, 9]:
            old, new = ({k: v for (r, k), v in seen.items() if r == x} for x in (n - 1, n))
            want += [(n, k, "alta") for k in new.keys() - old] + [(n, k, "baja") for k in old.keys() - new] + [(n, k, "cambio") for k in new if k in old and old[k] != new[k]]
        runs = [(i, "p" if i < 5 else "q", i + 1) for i in range(10)]
        for more in ({}, {"broadcast_keys": 3}, {"buckets": 1}):
            assert self.diff(spark, rows, runs, **more) == sorted(want)
