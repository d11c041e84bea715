"""The same rows and queries through the engine and through SQLite."""

import math
import random
import sqlite3

import pytest

from tessera.engine import Engine
from tessera.sources.memory import MemoryTable
from tessera.types import Affinity, Column, Schema

SCHEMA = Schema((Column("s", Affinity.TEXT), Column("i", Affinity.INTEGER), Column("r", Affinity.REAL)))
ROWS = [
    ("1", 1, 1.0),
    ("1.0", 2, 0.0),
    (None, None, None),
    ("abc", 9223372036854775807, 1e16),
    ("12x", -5, 2.5),
    (" 7 ", 3, 1.0),
    ("", 0, -3.75),
    ("a%b_c", -9223372036854775808, 9007199254740992.0),
    ("ABC", 9007199254740993, float("inf")),
    ("é\nÉ", 5, -2.0),
    ("1e3", 100, 0.1),
    ("abc", 2, None),
]


@pytest.fixture(scope="module")
def both(spark):
    db = sqlite3.connect(":memory:")
    db.execute("create table t(s TEXT, i INTEGER, r REAL)")
    db.executemany("insert into t values (?, ?, ?)", ROWS)
    return Engine(spark, {"t": MemoryTable(SCHEMA, ROWS)}), db


def cell(v):
    return (type(v).__name__, v.hex() if isinstance(v, float) else v)


def rows(found):
    return [tuple(map(cell, r)) for r in found]


def check(both, text, ordered=False):
    engine, db = both
    mine, theirs = rows(engine.rows(text)), rows(db.execute(text).fetchall())
    if not ordered:
        mine, theirs = sorted(mine, key=repr), sorted(theirs, key=repr)
    assert mine == theirs, text


LEAVES = ["s", "i", "r", "t.i", "1", "0", "-3", "2.5", "'1'", "'abc'", "' 2x'", "NULL", "9223372036854775807", "'1.5'", "0.0", "''"]


def expression(rng, depth):
    if depth == 0 or rng.random() < 0.15:
        return rng.choice(LEAVES)
    a, b, c = (expression(rng, depth - 1) for _ in range(3))
    return rng.choice(
        [
            f"({a} {rng.choice(['+', '-', '*', '/', '%', '||'])} {b})",
            f"({a} {rng.choice(['=', '<>', '<', '<=', '>', '>=', 'IS', 'IS NOT'])} {b})",
            f"({a} {rng.choice(['AND', 'OR'])} {b})",
            f"(NOT {a})",
            f"(- {a})",
            f"(+{a})",
            f"({a} IS NULL)",
            f"({a} IS NOT NULL)",
            f"({a} {rng.choice(['', 'NOT '])}BETWEEN {b} AND {c})",
            f"({a} {rng.choice(['', 'NOT '])}IN ({b}, {c}))",
            f"({a} {rng.choice(['', 'NOT '])}IN ())",
            f"({a} {rng.choice(['', 'NOT '])}LIKE {rng.choice(['%b%', 'A_C', 'abc', '1%', '%', ''])!r})",
        ]
    )


@pytest.mark.parametrize("seed", range(10))
def test_generated_expressions(both, seed):
    rng = random.Random(seed)
    items = [expression(rng, 1 + k % 2) for k in range(24)]
    check(both, f"SELECT {', '.join(items)} FROM t", ordered=True)


@pytest.mark.parametrize("seed", range(12))
def test_generated_conditions(both, seed):
    rng = random.Random(1000 + seed)
    check(both, f"SELECT s, i, r FROM t WHERE {expression(rng, 3)}", ordered=True)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT count(*), count(s), count(i), min(s), max(s), min(i), max(i), min(r), max(r), sum(r) FROM t WHERE r < 1000000000.0 OR 1",
        "SELECT sum(i), avg(r), sum(s), avg(s), sum(DISTINCT i), avg(DISTINCT r), count(DISTINCT s), sum(DISTINCT s) FROM t WHERE i BETWEEN -10 AND 200",
        "SELECT sum(i), avg(i), min(i), max(s), count(*) FROM t WHERE 0",
        "SELECT s IS NULL, count(*), sum(i % 7) FROM t GROUP BY s IS NULL",
        "SELECT s + 0, count(*), min(i) FROM t GROUP BY s + 0",
        "SELECT r, count(*) FROM t GROUP BY r",
        "SELECT s, count(*) FROM t GROUP BY s HAVING count(*) > 1 OR s LIKE '1%'",
        "SELECT count(*) FROM t GROUP BY s + 0 HAVING (s + 0) || 'x' = '1x'",
        "SELECT count(*) AS n, i % 2 FROM t GROUP BY i % 2 HAVING n > 1 AND i % 2 IS NOT NULL",
        "SELECT DISTINCT s + 0 FROM t",
        "SELECT DISTINCT i > 2, r IS NULL FROM t",
        "SELECT count(*) + 1, max(i) IS NULL, -count(s) FROM t",
        "SELECT i FROM t WHERE i = 9007199254740992.0",
        "SELECT r FROM t WHERE r = 9007199254740993 OR r > 9007199254740993",
        "SELECT i AS r, r AS x FROM t WHERE r > 1 AND x < 3",
        "SELECT i FROM t WHERE i = '2' AND i + 1 = 3 AND i > '1'",
        "SELECT i FROM t WHERE i IN (2) AND s LIKE 'a%'",
        "SELECT 1 FROM t WHERE i > 'a' OR r < 'a' OR s > 1",
        "SELECT i FROM t WHERE s = 1 OR s = 1.0",
        "SELECT s LIKE 'a!%b!_c' ESCAPE '!', s LIKE s, s LIKE 'É%', s LIKE '%\n%', i LIKE '%7', r LIKE '1%' FROM t",
    ],
)
def test_unordered(both, text):
    check(both, text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT s, i FROM t ORDER BY s, i",
        "SELECT s, i FROM t ORDER BY 2 DESC, s",
        "SELECT i FROM t ORDER BY r DESC, i LIMIT 4 OFFSET 2",
        "SELECT -i AS r, s FROM t ORDER BY r, s",
        "SELECT s FROM t ORDER BY s + 0, i",
        "SELECT s || '' AS x, count(*) FROM t GROUP BY s ORDER BY count(*) DESC, x",
        "SELECT i FROM t ORDER BY i LIMIT -1 OFFSET -3",
        "SELECT i FROM t ORDER BY i LIMIT 3 OFFSET 100",
        "SELECT DISTINCT s FROM t ORDER BY s DESC LIMIT 3",
        "SELECT i FROM t WHERE 'a' LIKE 'a' ESCAPE 'ab' LIMIT 0",
    ],
)
def test_ordered(both, text):
    check(both, text, ordered=True)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT sum(i) FROM t",
        "SELECT s FROM t WHERE s LIKE 'a' ESCAPE 'ab'",
        "SELECT s FROM t WHERE i > 0 AND s LIKE 'a' ESCAPE s || 'ab'",
        "SELECT 'a' LIKE 'a' ESCAPE 'ab' FROM t",
        "SELECT s FROM t WHERE 'a' LIKE 'a' ESCAPE 'ab' AND 1 = 0",
        "SELECT count(*) FROM t GROUP BY s HAVING max(s) LIKE 'a' ESCAPE 'ab'",
        "SELECT s FROM t WHERE i < 0 AND NOT (i = 5 AND s LIKE 'a' ESCAPE 'ab') AND i = 5",
    ],
)
def test_errors_when_run(both, text):
    engine, db = both
    raises = True
    try:
        db.execute(text).fetchall()
        raises = False
    except sqlite3.Error:
        pass
    if raises:
        with pytest.raises(Exception, match="ESCAPE|overflow"):
            engine.rows(text)
    else:
        engine.rows(text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT s FROM t WHERE s LIKE 'a' ESCAPE 'ab' AND 0",
        "SELECT s FROM t WHERE s LIKE 'a' ESCAPE 'ab' OR 1",
        "SELECT s FROM t WHERE i IS NULL AND i > 3 AND s LIKE 'a' ESCAPE 'ab'",
        "SELECT s FROM t WHERE 1 = 0 AND 'a' LIKE 'a' ESCAPE 'ab'",
        "SELECT count(*) FROM t HAVING max(s) LIKE 'a' ESCAPE 'ab' AND 0",
    ],
)
def test_what_does_not_run_does_not_raise(both, text):
    check(both, text)


def test_first_seen_is_shown(both):
    engine, _ = both
    assert engine.rows("SELECT DISTINCT r FROM t LIMIT 3") == [(1.0,), (0.0,), (None,)]
    found = engine.rows("SELECT s + 0, count(*) FROM t GROUP BY s + 0")
    assert [type(v) for v, _ in found[:2]] == [int, type(None)]


def test_compensated_sum(spark):
    table = MemoryTable(SCHEMA, [("a", 1, 1e16), ("a", 2, 1.0), ("a", 3, -1e16), ("b", 1, math.inf), ("b", 1, -math.inf)])
    engine = Engine(spark, {"t": table})
    assert engine.rows("SELECT s, sum(r) FROM t GROUP BY s") == [("a", 1.0), ("b", None)]


def test_running_sum_overflows_although_the_total_fits(spark):
    big = 9223372036854775807
    engine = Engine(spark, {"t": MemoryTable(SCHEMA, [("a", big, 0.0), ("a", 1, 0.0), ("a", -5, 0.0)])})
    with pytest.raises(Exception, match="overflow"):
        engine.rows("SELECT sum(i) FROM t")
    assert engine.rows("SELECT avg(i) FROM t") == [((big - 4) / 3,)]


CASES = [
    "CASE WHEN i > 2 THEN i WHEN r THEN r ELSE -1 END",
    "CASE i WHEN 1 THEN 'one' WHEN '2' THEN s WHEN 3.0 THEN 'three' END",
    "CASE s WHEN 1 THEN 10 WHEN 'abc' THEN 20 ELSE i / 2 END",
    "CASE WHEN s LIKE 'a%' THEN r WHEN NULL THEN 1 ELSE NULL END",
    "CASE WHEN i IS NULL THEN NULL END",
    "1 + CASE WHEN s THEN i ELSE r END * 2",
    "CASE WHEN i = 1 THEN i = 1 ELSE r < 1 END",
    "CASE WHEN i > 1 THEN CASE WHEN r > 0 THEN 'both' ELSE 'i' END ELSE 'none' END || s",
]


@pytest.mark.parametrize("text", CASES)
def test_case(both, text):
    check(both, f"SELECT {text} FROM t")
    check(both, f"SELECT i FROM t WHERE {text}")
    check(both, f"SELECT count(*), {text} FROM t GROUP BY {text}")
    check(both, f"SELECT max(CASE WHEN i > 0 THEN i END), sum(CASE WHEN s > '1' THEN 1 ELSE 0 END) FROM t")


def test_case_raises_only_where_it_gets(both):
    engine, _ = both
    bad = "s LIKE 'x' ESCAPE 'ab'"
    assert engine.rows(f"SELECT count(CASE WHEN i = 77 THEN {bad} ELSE 1 END) FROM t") == [(12,)]
    assert engine.rows(f"SELECT count(CASE WHEN 1 THEN 2 WHEN {bad} THEN 1 END) FROM t") == [(12,)]
    from tessera.errors import QueryError, Sort

    with pytest.raises(QueryError) as e:
        engine.rows(f"SELECT CASE WHEN i = 1 THEN {bad} END FROM t")
    assert e.value.sort is Sort.VALUE
    with pytest.raises(QueryError) as e:
        engine.rows("SELECT CASE WHEN i = 1 THEN s ELSE i END FROM t")
    assert e.value.sort is Sort.OMITTED


OTHER = [("1", 1), ("abc", 2), ("12x", 2), (None, 3), ("1.0", None), ("abc", 9007199254740993), ("0.5", 0)]
OTHER_SCHEMA = Schema((Column("s", Affinity.TEXT), Column("k", Affinity.INTEGER)))
JOINS = [
    "SELECT t.s, u.s, i, k FROM t JOIN u ON t.s = u.s",
    "SELECT t.s, k FROM t INNER JOIN u ON k = i",
    "SELECT s, i, k FROM t JOIN u USING (s)",
    "SELECT * FROM t JOIN u USING (s)",
    "SELECT t.*, u.s FROM t JOIN u ON t.i = u.k AND t.s <> u.s",
    "SELECT i, r, k FROM t JOIN u ON r = k",
    "SELECT i, u.s FROM t JOIN u ON i = u.s",
    "SELECT t.s, k FROM t JOIN u ON u.s = r WHERE k > 0 OR t.s LIKE 'a%'",
    "SELECT a.i, b.i FROM t AS a JOIN t AS b ON a.s = b.s AND a.i < b.i",
    "SELECT a.k, b.k, t.i FROM u AS a JOIN u AS b ON a.s = b.s JOIN t ON t.i = b.k AND t.i = a.k",
    "SELECT u.s, count(*), sum(i), max(k) FROM t JOIN u ON t.i = u.k GROUP BY u.s HAVING count(*) > 0 ORDER BY 1",
    "SELECT DISTINCT k FROM t JOIN u ON t.s = u.s WHERE 1 = 1 AND k = 2",
    "SELECT count(*) FROM t JOIN u ON t.s = u.s WHERE 0",
    "SELECT s AS k FROM t JOIN u USING (s) ORDER BY k LIMIT 2",
]


@pytest.mark.parametrize("text", JOINS)
def test_joins(spark, both, text):
    _, db = both
    db.execute("drop table if exists u")
    db.execute("create table u(s TEXT, k INTEGER)")
    db.executemany("insert into u values (?, ?)", OTHER)
    check((Engine(spark, {"t": MemoryTable(SCHEMA, ROWS), "u": MemoryTable(OTHER_SCHEMA, OTHER)}), db), text)


@pytest.mark.parametrize(
    ("text", "what"),
    [
        ("SELECT s FROM t JOIN u ON t.s = u.s", "ambiguous column name: s"),
        ("SELECT 1 FROM t JOIN t ON i = i", "two tables are named t"),
        ("SELECT 1 FROM t JOIN v ON i = k", "no such table: v"),
        ("SELECT 1 FROM t JOIN u USING (k)", "no such column: k"),
        ("SELECT 1 FROM t JOIN u ON i > k", "no join without an equality"),
        ("SELECT 1 FROM t JOIN u ON count(*) = k", "misuse of aggregate function count"),
        ("SELECT t.i FROM t AS x JOIN u ON i = k", "no such column: t.i"),
        ("SELECT 1 FROM t JOIN u AS x ON x.s = later.s JOIN u AS later ON x.s = later.s", "no such column: later.s"),
        ("SELECT 1 FROM t JOIN u", "ON or USING must follow"),
        ("SELECT 1 FROM t LEFT JOIN u ON i = k", "no outer and cross joins"),
    ],
)
def test_wrong_joins(spark, text, what):
    from tessera.errors import QueryError

    engine = Engine(spark, {"t": MemoryTable(SCHEMA, ROWS), "u": MemoryTable(OTHER_SCHEMA, OTHER)})
    with pytest.raises(QueryError, match=what.replace("(", r"\(")):
        engine.frame(text)
