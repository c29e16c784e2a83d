"""Every query with SQL against DuckDB on the same tables; the others return rows."""

import os

import duckdb
import pytest

from skeinquery.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, got) == canonical(columns, want.fetchall())


def test_sql_has_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
