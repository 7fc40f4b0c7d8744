"""Every query of the subpackage against its SQL, or against a plain computation of what it must hold."""

import glob
import math
import os
import re
import unicodedata
from collections import Counter, defaultdict

import pytest

from tablon.llm import queries

DATA = os.environ.get("TABLON_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.fixture(scope="module")
def library():
    import base64

    import tiktoken
    from tiktoken_ext.openai_public import r50k_pat_str

    from tablon.llm.tokens import read_vocabulary

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, read_vocabulary("byte_bpe_50k").splitlines())}
    return tiktoken.Encoding("own", pat_str=r50k_pat_str, mergeable_ranks=ranks, special_tokens={})


def folded(text):
    apart = unicodedata.normalize("NFD", text.lower())
    return " ".join(re.findall("[a-z]+", "".join(c for c in apart if not unicodedata.combining(c))))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, DATA)
    rel = sql.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(rel.select(*columns).fetchall())


def test_no_query_is_without_a_check():
    text = open(__file__).read()
    assert all(n in queries.ORACLES or f"def test_{n}(" in text for n in queries.QUERIES)


def test_p3_found(spark, sql):
    got = dict(map(tuple, queries.p3_found(spark, DATA).collect()))
    names = {folded(n): i for i, n in sql.sql("select distrito_id, nombre from distritos").fetchall()}
    names |= {folded(a): i for i, a in sql.sql("select distrito_id, alias_texto from distritos_alias").fetchall()}
    typed = dict(sql.sql("select distinct anuncio_id, distrito from anuncios where trim(distrito) <> ''").fetchall())
    assert got.keys() == typed.keys()
    for i, value in typed.items():
        if folded(value) in names:
            assert got[i] == names[folded(value)]
        elif got[i] == -1:  # nothing on the list is near
            assert all(edits(folded(value), n) > 0.12 * len(n) for n in names)


def test_p7_found(spark, sql):
    pairs = [tuple(r) for r in queries.p7_found(spark, DATA).collect()]
    texts = dict(sql.sql("select distinct anuncio_id, ubicacion from anuncios where ubicacion is not null").fetchall())
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
        assert a < b and set(re.findall(r"\d+", texts[a])) & set(re.findall(r"\d+", texts[b]))
    assert len(set(pairs)) == len(pairs) and all(near[a] | {a} == near[b] | {b} for a, b in pairs)  # places are classes
    same = sql.sql("""select a.anuncio_id, b.anuncio_id from (select distinct anuncio_id, ubicacion, distrito from anuncios) a join (select distinct anuncio_id, ubicacion, distrito from anuncios) b
      on a.ubicacion = b.ubicacion and a.distrito = b.distrito and a.anuncio_id < b.anuncio_id where regexp_matches(a.ubicacion, '[0-9]{3,}')""").fetchall()
    assert set(same) <= set(pairs) and pairs


def test_p8_ids(spark, sql, library):
    got = {r["doc_id"]: list(r["ids"]) for r in queries.p8_ids(spark, DATA).collect()}
    assert got == {i: library.encode_ordinary(t) if t else [] for i, t in sql.sql("select doc_id, text from documents").fetchall()}


def _sizes(sql, library):
    sizes = Counter()
    for source, text in sql.sql("select source, text from documents where source is not null and text is not null").fetchall():
        sizes[source] += len(library.encode_ordinary(text))
    return sizes


def test_p9_mezcla(spark, sql, library):
    rows = queries.p9_mezcla(spark, DATA).collect()
    docs = {i: (s, len(library.encode_ordinary(t)) if t else 0) for i, s, t in sql.sql("select doc_id, source, text from documents").fetchall()}
    targets = {s: (w, m) for s, w, m in sql.sql("select source, peso_objetivo, max_repeticiones from mezcla_fuentes").fetchall()}
    assert all((r["source"], r["tokens"]) == docs[r["doc_id"]] for r in rows) and len({(r["doc_id"], r["copia"]) for r in rows}) == len(rows)
    assert all(r["copia"] <= targets[r["source"]][1] for r in rows)
    given = Counter()
    for r in rows:
        given[r["source"]] += r["tokens"]
    live = {s: w for s, (w, _) in targets.items() if any(x == s and n for x, n in docs.values()) and w > 0}
    longest = max(n for _, n in docs.values())
    for s, w in live.items():
        assert abs(given[s] - sum(given.values()) * w / sum(live.values())) <= 2 * longest


def test_p9_reporte(spark, sql, library):
    sizes, report = _sizes(sql, library), {r["source"]: r for r in queries.p9_reporte(spark, DATA).collect()}
    given = Counter()
    for r in queries.p9_mezcla(spark, DATA).collect():
        given[r["source"]] += r["tokens"]
    assert report.keys() == {s for (s,) in sql.sql("select source from mezcla_fuentes").fetchall()}
    for s, r in report.items():
        assert (r["tokens_fuente"], r["tokens_mezcla"]) == (sizes[s], given[s]) and r["participacion"] == pytest.approx(given[s] / sum(given.values()), abs=1e-6) and r["exponente"] == 0


def test_p9_temperatura(spark, sql, library):
    targets = {s: (w, m) for s, w, m in sql.sql("select source, peso_objetivo, max_repeticiones from mezcla_fuentes").fetchall()}
    sizes = {s: n for s, n in _sizes(sql, library).items() if s in targets and n}
    rows = {r["source"]: r for r in queries.p9_temperatura(spark, DATA).collect()}
    power = next(iter(rows.values()))["exponente"]
    raised = {s: n**power for s, n in sizes.items()}
    shares = {s: x / sum(raised.values()) for s, x in raised.items()}
    assert {s: r["participacion"] for s, r in rows.items()} == pytest.approx(shares, abs=1e-5) and {s: r["tokens_fuente"] for s, r in rows.items()} == sizes
    whole = sum(targets[s][0] for s in sizes)
    entropy = -sum(w / whole * math.log(w / whole) for w, _ in (targets[s] for s in sizes))
    own = -sum(x * math.log(x) for x in shares.values())
    worst = max(shares[s] * sum(sizes.values()) / (targets[s][1] * n) for s, n in sizes.items())
    assert own <= entropy + 1e-4 and worst <= 1 + 1e-4 and (power == 0 or own > entropy - 1e-3 or worst > 1 - 1e-3)
