"""Every query of the engine against its SQL."""

import math

import duckdb
import pytest

from graphloom import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, duck, name):
    df = own.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(([r[c] for c in columns] for r in df.collect()), key=str)
    if name not in own.oracle_sql():
        assert rows
        return
    out = duck.sql(own.oracle_sql()[name])
    at = [out.columns.index(c) for c in columns]
    want = sorted(([r[k] for k in at] for r in out.fetchall()), key=str)
    assert sorted(out.columns) == columns and len(rows) == len(want)
    assert all(same(x, y) for r, w in zip(rows, want) for x, y in zip(r, w))
    assert {c: KINDS[t] for c, t in df.dtypes} == dict(zip(out.columns, map(str, out.types)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
