"""The queries that SQL can express against it."""

import os

import duckdb
import pytest

from transitloom.llm import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df, want = queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = want.project(", ".join(f'"{c}"' for c in df.columns)).fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, rows))
