"""Every registered query of the graph engine against its SQL oracle at the smallest scale."""

import os

import duckdb
import pytest
from compare import TABLES, rows_of

from graphloom.plans import catalog, catalog_more, codebase, extraction  # noqa: F401

SF = "/root/testdata/sf0.001"
QUERIES = {**catalog.QUERIES, **extraction.QUERIES}
ORACLES = {**catalog.ORACLES, **extraction.ORACLES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())
