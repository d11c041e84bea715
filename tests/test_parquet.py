"""Parquet columns of every type, and times whatever the session's time zone."""

from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.engine import Engine
from tessera.errors import QueryError, Sort
from tessera.sources.parquet import ParquetTable


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    out = str(tmp_path_factory.mktemp("types") / "t.parquet")
    moments = [datetime(2024, 1, 1), datetime(2024, 3, 10, 2, 30), datetime(2024, 11, 3, 5, 30), datetime(1969, 12, 31, 23, 59, 59), None]
    pq.write_table(
        pa.table(
            {
                "k": pa.array(range(5), pa.int64()),
                "whole": pa.array([Decimal(10**17), Decimal(-5), None, Decimal(0), Decimal(7)], pa.decimal128(18, 0)),
                "part": pa.array([Decimal("1.25"), Decimal("-0.50"), None, Decimal("0.00"), Decimal("9.99")], pa.decimal128(5, 2)),
                "flag": pa.array([True, False, None, True, False]),
                "day": pa.array([d and date(d.year, d.month, d.day) for d in moments]),
                "plain": pa.array(moments, pa.timestamp("us")),
                "moment": pa.array(moments, pa.timestamp("us", tz="UTC")),
                "many": pa.array([[1.0]] * 5, pa.list_(pa.float32())),
                "bytes": pa.array([b"x"] * 5),
            }
        ),
        out,
    )
    return out


ISO = ["2024-01-01T00:00:00Z", "2024-03-10T02:30:00Z", "2024-11-03T05:30:00Z", "1969-12-31T23:59:59Z", None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_are_told_in_utc(spark, path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        engine = Engine(spark, {"t": ParquetTable(spark, path)})
        rows = sorted(engine.rows("SELECT k, day, plain, moment FROM t"))
        assert [r[3] for r in rows] == ISO and [r[2] for r in rows] == ISO
        assert [r[1] for r in rows] == [x and x[:10] + "T00:00:00Z" for x in ISO]
        for name in ("plain", "moment"):
            for k, text in enumerate(ISO[:4]):  # each is found by its own text
                assert engine.rows(f"SELECT k FROM t WHERE {name} = '{text}'") == [(k,)]
                assert sorted(engine.rows(f"SELECT k FROM t WHERE {name} < '{text}'")) == [(i,) for i, x in enumerate(ISO) if x and x < text]
            assert engine.rows(f"SELECT max({name}) FROM t") == [("2024-11-03T05:30:00Z",)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_comparisons_of_times_reach_the_scan(spark, path):
    engine = Engine(spark, {"t": ParquetTable(spark, path)})
    for name in ("plain", "moment"):
        plan = engine.frame(f"SELECT k FROM t WHERE {name} >= '2024-02'")._jdf.queryExecution().executedPlan().toString()
        assert f"GreaterThanOrEqual({name}" in plan


def test_decimals_and_booleans(spark, path):
    engine = Engine(spark, {"t": ParquetTable(spark, path)})
    assert sorted(engine.rows("SELECT k, whole, part, flag, whole + 1, flag + 1 FROM t")) == [
        (0, 10**17, 1.25, 1, 10**17 + 1, 2), (1, -5, -0.5, 0, -4, 1), (2, None, None, None, None, None), (3, 0, 0.0, 1, 1, 2), (4, 7, 9.99, 0, 8, 1),
    ]
    assert engine.rows("SELECT sum(flag), sum(whole), count(part) FROM t WHERE flag") == [(2, 10**17, 2)]


def test_other_types_are_refused_by_name(spark, path):
    engine = Engine(spark, {"t": ParquetTable(spark, path)})
    for text, what in (("SELECT * FROM t", "many"), ("SELECT count(bytes) FROM t", "bytes is a column of BINARY"), ("SELECT k FROM t WHERE many IS NULL", "many is a column of ARRAY<FLOAT>")):
        with pytest.raises(QueryError, match=what) as e:
            engine.frame(text)
        assert e.value.sort is Sort.NAME
    assert engine.rows("SELECT count(*) FROM t") == [(5,)]
