"""Every query against its SQL, on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from tablon.plans import reference_queries, source_queries, training_queries  # noqa: F401

DATA = os.environ.get("TABLON_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(rows):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, float):
            return round(x, 6)
        if isinstance(x, (list, tuple)):
            return tuple(map(cell, x))
        return x.isoformat() if hasattr(x, "isoformat") else x if isinstance(x, (str, bool)) else float(x)

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


# Queries that SQL can't express, and the tests that compare their operator with brute force.
CHECKED = {"q_dup_signal_groups": "test_operators.py", "q_similarity": "test_operators.py"}


@pytest.mark.parametrize("name", [*reference_queries.QUERIES, *training_queries.QUERIES])
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*columns).collect())
    if name in entry.oracle_sql():
        rel = sql.sql(entry.oracle_sql()[name])
        assert sorted(rel.columns) == columns
        assert got == plain(rel.select(*columns).fetchall())
    else:
        tests = os.path.join(os.path.dirname(__file__), CHECKED[name])  # a query without any check fails here
        assert f"checks {name}" in open(tests).read() and got


def test_entry(spark):
    assert entry.entry(spark).columns == ["corrida_id", "enlace", "cambio"]
