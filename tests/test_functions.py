from datetime import date

import pytest
from pyspark.sql import functions as F

from tablon.functions import dates, identity, numbers, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("HTTPS://Host.example/a/b/?x=1#y", "https://Host.example/a/b"),
        ("https://h.example/a;s=1?q", "https://h.example/a"),
        ("https://h.example///", "https://h.example"),
        ("  https://h.example/a  ", "https://h.example/a"),
        ("/solo/ruta/", "/solo/ruta"),
        ("", ""),
        (None, ""),
    ],
)
def test_canonical_link(spark, raw, clean):
    assert one(spark, raw, identity.canonical_link) == clean
    assert one(spark, clean, identity.canonical_link) == clean


def test_publication_id_prefers_the_posting(spark):
    rows = spark.createDataFrame([("S", " P ", None, "https://h/a", "Id9"), ("S", "", "V", "https://h/a?x", " ")], "s string, p string, o string, e string, i string")
    got = [r[0] for r in rows.select(identity.publication_id(*[F.col(c) for c in "spoei"])).collect()]
    assert got[0] == "s:p:sin_operacion:posting:Id9"
    assert got[1].startswith("s:sin_portal:v:url:") and len(got[1].split(":")[-1]) == 16


def test_texts(spark):
    assert one(spark, "  ÁRBOL  ñandú ", text.normal_text) == "arbol nandu"
    assert one(spark, None, text.normal_text) == ""
    assert one(spark, " A  B. ", text.hash_text) == "a b."
    assert one(spark, "Café-Bar, 2º", text.dedup_text) == "cafe bar 2"
    assert one(spark, "b a  c", text.token_sort) == "a b c"
    assert one(spark, "ab casa mesa", text.block_token) == "casa"
    assert one(spark, "ab c", text.block_token) == "ab"
    assert one(spark, "", text.block_token) == ""
    assert one(spark, "¡¡!!", identity.safe_slug) == "sin_valor"


def test_values_match_leaves_out_nan(spark):
    rows = spark.createDataFrame([(100.0, 104.0), (float("nan"), float("nan")), (None, 1.0), (0.0, 0.0)], "a double, b double")
    assert [r[0] for r in rows.select(text.values_match(F.col("a"), F.col("b"), 0.05)).collect()] == [True, False, False, False]


def test_numbers(spark):
    assert one(spark, "S/ 2,460", numbers.first_number) == 2460.0
    assert one(spark, "100.5 m²", numbers.first_number) == 100.5
    assert one(spark, "S/. 2,500", numbers.first_number) is None
    assert one(spark, "3 dormitorios", numbers.first_integer) == 3
    assert one(spark, "9" * 40, numbers.first_integer) is None
    assert one(spark, "n.d.", numbers.rate_number) is None
    assert one(spark, "1,234.5", numbers.rate_number) == 1234.5


@pytest.mark.parametrize(
    ("phrase", "day"),
    [
        ("Publicado hace 1 semana, 5 dias", date(2026, 4, 10)),
        ("hace 2 meses", date(2026, 2, 21)),
        ("23 may. 2022", date(2022, 5, 23)),
        ("31 feb 2022", None),
        ("hoy", date(2026, 4, 22)),
        ("desde ayer", date(2026, 4, 21)),
        ("hace 5 horas", date(2026, 4, 22)),
        ("3 días", None),
        ("3 enero 2022", None),
        (None, None),
    ],
)
def test_relative_dates(spark, phrase, day):
    assert one(spark, phrase, lambda c: dates.relative_date(c, F.lit("2026-04-22").cast("date"))) == day


def test_periods(spark):
    df = spark.createDataFrame([("2026-05-16T08:00",), ("x 2026/2",), ("2026-13-01",), (None,)], "f string")
    rows = dates.with_periods(df, "f").collect()
    assert [(r["anio"], r["trimestre"], r["mes"]) for r in rows] == [(2026, "2026-T2", "2026-05"), (2026, "2026-T1", "2026-02"), (None, None, None), (None, None, None)]
    assert dates.with_periods(df, "no_existe").first()["anio"] is None
