"""Every query of the library against its SQL in DuckDB, and the entry module."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans.queries import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = catalogue()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def tidy(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", [k for k, (_, sql) in QUERIES.items() if sql])
def test_same_rows_as_sql(spark, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, DATA)
    columns = sorted(df.columns)
    got = duck.execute(sql)
    found = [x[0] for x in got.description]
    assert sorted(found) == columns
    want = [tuple(r[found.index(c)] for c in columns) for r in got.fetchall()]
    assert tidy(df.select(*[f"`{c}`" for c in columns]).collect()) == tidy(want)


@pytest.mark.parametrize("name", [k for k, (_, sql) in QUERIES.items() if not sql])
def test_rows_without_sql(spark, name):
    assert QUERIES[name][0](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
