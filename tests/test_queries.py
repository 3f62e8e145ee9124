"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import catalog



@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def value(v):
    if v is None or v != v:
        return "null"
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, db, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in catalog.ORACLES:
        assert len(df.columns) == len(set(df.columns))
        return
    sql = db.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    a, b = rows(df.columns, got), rows(sql.columns, sql.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-5)) for p, q in zip(x, y)), (x, y)
