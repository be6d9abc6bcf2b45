"""Every query against its SQL on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from transitloom.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def cell(v):
    return "~" if v is None else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    sql = duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    want = sorted(tuple(map(cell, r)) for r in sql.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
