"""Every registered query of the dialect against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tessera import queries as base

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in base.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    return ("float", f"{v:.12g}") if isinstance(v, float) else (type(v).__name__, str(v))


@pytest.mark.parametrize("name", list(base.QUERIES))
def test_matches(spark, db, name):
    mine = base.QUERIES[name](spark, SF)
    theirs = db.sql(base.ORACLES[name])
    names = sorted(mine.columns)
    assert names == sorted(theirs.columns)
    place = [theirs.columns.index(n) for n in names]
    a = sorted(tuple(cell(r[n]) for n in names) for r in mine.collect())
    assert a == sorted(tuple(cell(r[i]) for i in place) for r in theirs.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_scans_are_narrow(spark):
    """Only the columns used are read, and comparisons reach the scan."""
    text = "SELECT l_returnflag, count(*) FROM lineitem WHERE l_shipdate >= '1997' AND l_orderkey < 5.5 GROUP BY l_returnflag"
    from tessera.engine import Engine

    df = Engine(spark, base.catalog(spark, SF, ["lineitem"])).frame(text)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string,l_shipdate:timestamp" in plan
    assert "GreaterThanOrEqual(l_shi" in plan and "Python" not in plan and "Arrow" not in plan


def test_joins_are_narrow(spark):
    """Only the columns used are read on either side, their terms reach both scans, and equal columns are the join's keys."""
    df = base.QUERIES["inner_join"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double,c_mktsegment:string>" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_orderpriority:string>" in plan
    assert "GreaterThan(c_acctbal" in plan and "Not(EqualTo(o_orderstatus" in plan
    assert "HashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
