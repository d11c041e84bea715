"""Queries with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def cell(v):
    return f"{v:.12g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_matches(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    names = sorted(mine.columns)
    assert names == sorted(theirs.columns)
    place = [theirs.columns.index(n) for n in names]
    found = sorted(tuple(cell(r[n]) for n in names) for r in mine.collect())
    assert found == sorted(tuple(cell(r[i]) for i in place) for r in theirs.fetchall())
