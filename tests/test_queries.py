"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from weftline.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: "" if x is None else round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(str(show(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= len(QUERIES)
