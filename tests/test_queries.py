"""Every query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from lumenframe import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else 0.0 if v == 0 and isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, data, con, name):
    got = registry.QUERIES[name](spark, data)
    rows = con.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in rows.description]
    assert sorted(cols) == sorted(got.columns)
    order = lambda rs: sorted((tuple(map(plain, r)) for r in rs), key=repr)
    assert order(tuple(r) for r in got.select(*cols).collect()) == order(rows.fetchall())


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
