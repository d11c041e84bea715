"""Lexer, parser, binder, rewrites and plan text, without Spark."""

import pytest

from tessera.errors import QueryError, Sort
from tessera.functions.numbers import prefix_number, real_to_text, text_to_real, whole_number
from tessera.functions.values import Constant, like_pattern
from tessera.plans.binder import bind
from tessera.plans.lexer import tokenize
from tessera.plans.parser import parse
from tessera.plans.plan import explain, plan, push_down, sql
from tessera.sources.blame import SCHEMA, BlameTable

CATALOG = {"blame": SCHEMA}


def value(text):
    item = bind(parse(f"SELECT {text} FROM blame"), CATALOG).items[0]
    return Constant(SCHEMA).value(item.expr)


def trouble(text):
    """The error that a query meets before it has a plan."""
    from tessera.engine import deep

    with deep(), pytest.raises(QueryError) as e:
        bind(parse(text), CATALOG)
    return e.value


def plan_text(text):
    op = push_down(plan(bind(parse(text), CATALOG)), BlameTable(".").accepts)
    return explain(op, lambda scan: f"Scan ({', '.join(map(sql, scan.pushed)) or 'none'})")


def test_tokens():
    kinds = [t.kind for t in tokenize("SELECT \"a\"\"b\", 'it''s' -- note\n <> != .5 1. 3 é_$")]
    assert kinds == ["SELECT", "name", ",", "string", "<>", "<>", "real", "real", "int", "name", "end"]
    assert tokenize("'it''s'")[0].text == "it's"
    assert tokenize("a\n  b")[1].at.line == 2 and tokenize("a\n  b")[1].at.column == 3


@pytest.mark.parametrize("text", ["'open", '"open', "3abc", "a ? b", "\x0b1"])
def test_bad_tokens(text):
    assert trouble(text).sort is Sort.TOKEN


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("1 + 2 * 3", 7),
        ("'a' || 1 + 1", 1),
        ("3 = 0 < 3", 0),
        ("1 = 1 = 1", 1),
        ("NOT 1 = 2", 1),
        ("- - 3", 3),
        ("-9223372036854775808", -(2**63)),
        ("9223372036854775808", 2.0**63),
        ("((1) + 1) * 2", 4),
        ("1 BETWEEN 0 AND 2 AND 0", 0),
        ("1 IN (1, 2) = 1", 1),
        ("NULL IS NULL", 1),
        ("NULL AND 0", 0),
        ("NULL OR 0", None),
        ("-7 / 2", -3),
        ("-7 % 3", -1),
        ("1 / 0", None),
        ("5 = '5'", 0),
        ("'1e3' % 7", 1.0),
        ("'1.5e2' % 7", 1.0),
        ("'1e400' % 3", 1.0),
        ("('1e400'+0) % 3", 1.0),
        ("'7abc' % 2", 1),
        ("9007199254740993 = 9007199254740992.0", 0),
        ("'10%' LIKE '10!%' ESCAPE '!'", 1),
        ("'É' LIKE 'é'", 0),
        ("'a' LIKE 'A'", 1),
        ("'ab' LIKE 'a!' ESCAPE '!'", 0),
        ("-9223372036854775808 / -1", 2.0**63),
        ("CASE WHEN NULL THEN 1 WHEN 2 > 1 THEN 'x' ELSE 3 END", "x"),
        ("CASE 1 WHEN '1' THEN 2 WHEN 1.0 THEN 3 END", 3),
        ("CASE NULL WHEN NULL THEN 1 END", None),
        ("CASE WHEN 1 THEN 2 ELSE 'a' LIKE 'a' ESCAPE 'ab' END + 1", 3),
    ],
)
def test_constants(text, out):
    found = value(text)
    assert found == out and type(found) is type(out)


@pytest.mark.parametrize(("text", "sign"), [("-(0.0)", "-0.0"), ("-(+0.0)", "-0.0"), ("-'0.0'", "0.0"), ("-(-0.0)", "0.0")])
def test_sign_of_zero(text, sign):
    assert str(value(text)) == sign


def test_text_to_real():
    for power in range(64):  # whole numbers of up to 19 digits that a real holds
        assert text_to_real(str(2**power)) == 2.0**power
    assert [text_to_real(x) for x in ("9e999", "0.25", "7.5e1", "0e5", "4e-900")] == [float("inf"), 0.25, 75.0, 0.0, 0.0]
    assert [prefix_number(x) for x in ("\t42kg", "\x1f42", "\u200342", "3e+", "0b1", "-.25.", "+", "18446744073709551616")] == [42, 0, 0, 3, 0, -0.25, 0, 2.0**64]
    assert [whole_number(x) for x in ("\n-8 ", "8 8", "-0.5", " ", "5E1")] == [-8, None, -0.5, None, 50.0]


def test_long_numerals_are_near():
    """Of up to 25 digits: within a unit in the last place of the nearest real."""
    import math
    import random

    rng = random.Random(6)
    for _ in range(2000):
        text = f"{rng.randrange(10 ** rng.randrange(16, 26))}e{rng.randrange(-200, 200)}"
        assert abs(text_to_real(text) - float(text)) <= math.ulp(float(text))


def test_short_numerals_are_rounded_correctly():
    import random

    rng = random.Random(5)
    for _ in range(4000):
        digits = str(rng.randrange(10 ** rng.randrange(1, 16)))
        text = digits[: rng.randrange(len(digits) + 1)] + "." + digits[-rng.randrange(1, 3) :] if rng.random() < 0.5 else digits
        if len(text) <= 15:
            assert text_to_real(text) == float(text)


def test_real_to_text():
    assert [real_to_text(x) for x in (1.0, 1e20, 1 / 3, -0.0, float("-inf"), 1e-7, 123456789012345680.0)] == ["1.0", "1.0e+20", "0.333333333333333", "0.0", "-Inf", "1.0e-07", "1.23456789012346e+17"]


def test_like_pattern():
    assert like_pattern("A%_!", None) == "a.*.!"
    assert like_pattern("a!", "!") is None


@pytest.mark.parametrize(
    ("text", "what"),
    [
        ("WITH x AS (SELECT 1) SELECT 1 FROM blame", "CTEs"),
        ("SELECT 1 FROM (SELECT 1)", "subqueries"),
        ("SELECT (SELECT 1) FROM blame", "subqueries"),
        ("SELECT 1 FROM blame WHERE EXISTS (SELECT 1)", "subqueries"),
        ("SELECT 1 FROM blame WHERE 1 IN (SELECT 1)", "subqueries"),
        ("SELECT count(*) OVER () FROM blame", "window functions"),
        ("SELECT 1 FROM blame UNION SELECT 2 FROM blame", "compound queries"),
        ("SELECT 1 FROM blame LEFT OUTER JOIN blame", "outer and cross joins"),
        ("SELECT 1 FROM blame CROSS JOIN blame", "outer and cross joins"),
    ],
)
def test_named_rejections(text, what):
    found = trouble(text)
    assert found.sort is Sort.OMITTED and what in str(found) and found.at.line == 1


@pytest.mark.parametrize(
    "text",
    [
        "SELECT path p FROM blame", "SELECT * AS a FROM blame", "SELECT 1 FROM blame LEFT", "SELECT 1 FROM blame JOIN blame", "SELECT 1 FROM blame LIMIT 1, 2",
        "SELECT 1 FROM blame WHERE", "SELECT foo(1, *) FROM blame", "SELECT 1 FROM blame; SELECT 2", "SELECT 1 = NOT 0 FROM blame", "SELECT (1 FROM blame",
        "SELECT CASE END FROM blame", "SELECT CASE 1 THEN 2 END FROM blame", "SELECT CASE WHEN 1 THEN 2 FROM blame", "SELECT CASE WHEN 1 THEN 2 ELSE END FROM blame", "SELECT count(DISTINCT *) FROM blame", "SELECT 1 NOT 2 FROM blame", "SELECT 1 FROM a, b",
    ],
)
def test_parse_errors(text):
    assert trouble(text).sort is Sort.GRAMMAR


@pytest.mark.parametrize(
    ("inner", "fine"),
    [
        ("(" * 1000 + "1" + ")" * 1000, True),
        ("(" * 1001 + "1" + ")" * 1001, False),
        ("- " * 999 + "1", True),
        ("- " * 1000 + "1", False),
        ("NOT " * 999 + "1", True),
        ("1" + " + 1" * 999, True),
        ("1" + " + 1" * 1000, False),
        ("(1 + " * 24 + "1" + ")" * 24, True),
        ("(1 + " * 25 + "1" + ")" * 25, False),
        ("0 AND " * 3000 + "0", True),
    ],
)
def test_depth(inner, fine):
    from tessera.engine import deep

    with deep():
        if fine:
            bind(parse(f"SELECT {inner} FROM blame"), CATALOG)
        else:
            assert trouble(f"SELECT {inner} FROM blame").sort is Sort.GRAMMAR


#: By what is wrong: queries, and words of what they are told.
WRONG = {
    "no such table": ["SELECT 1 FROM lines", "SELECT nobody FROM lines WHERE count(*)", "SELECT lines.*, path FROM blame"],
    "no such column: owner": [
        "SELECT owner FROM blame",
        "SELECT owner, other FROM blame",
        "SELECT count(*) FROM blame GROUP BY owner",
        "SELECT count(*) FROM blame WHERE line_no > 1 HAVING owner > 1",
        "SELECT path FROM blame ORDER BY 40, owner",
        "SELECT sum(line_no + owner) FROM blame",
        "SELECT upper(owner) FROM blame",
        "SELECT path FROM blame WHERE 1 IN (path, owner)",
        "SELECT path FROM blame WHERE other LIKE owner",
        "SELECT path FROM blame WHERE path BETWEEN owner AND other",
    ],
    "no such column: lines.path": ["SELECT lines.path FROM blame"],
    "no such column: line_no": ["SELECT path FROM blame LIMIT 2 OFFSET line_no"],
    "no such function: upper": ["SELECT upper(path) FROM blame", "SELECT path FROM blame WHERE line_no = upper(path)", "SELECT path FROM blame LIMIT upper('x')"],
    "wrong number of arguments to function avg()": ["SELECT avg(*) FROM blame", "SELECT avg() FROM blame", "SELECT avg(line_no, 2) FROM blame"],
    "misuse of aggregate function max()": [
        "SELECT path FROM blame WHERE max(line_no) = 3",
        "SELECT path FROM blame ORDER BY max(line_no)",
        "SELECT max(line_no) FROM blame WHERE max(line_no) = 3",
        "SELECT min(max(line_no)) FROM blame",
        "SELECT path FROM blame LIMIT max(1)",
    ],
    "misuse of aliased aggregate m": ["SELECT max(line_no) AS m FROM blame HAVING min(m) = 1"],
    "HAVING clause on a non-aggregate query": ["SELECT path FROM blame HAVING path = 'x'", "SELECT path FROM blame WHERE owner HAVING other"],
    "not allowed in the GROUP BY clause": ["SELECT 1 FROM blame GROUP BY max(line_no)", "SELECT max(line_no) AS m FROM blame GROUP BY m"],
    "1st ORDER BY term out of range - should be between 1 and 2": ["SELECT path, line FROM blame ORDER BY 3", "SELECT path, line FROM blame ORDER BY -1"],
    "3rd GROUP BY term out of range - should be between 1 and 2": ["SELECT path, line FROM blame GROUP BY 1, 2, 7"],
    "author_name differs among the rows of a group": ["SELECT author_name FROM blame GROUP BY path", "SELECT path FROM blame GROUP BY path HAVING author_name = 'x'", "SELECT path FROM blame GROUP BY path ORDER BY author_name"],
    "author_name differs among the rows that become one": ["SELECT author_name, max(line_no) FROM blame"],
    "that isn't line": ["SELECT DISTINCT path FROM blame ORDER BY line", "SELECT DISTINCT path, line_no FROM blame ORDER BY line || path"],
    "that isn't max()": ["SELECT DISTINCT path FROM blame GROUP BY path ORDER BY max(line_no)"],
    "LIMIT takes a whole number": ["SELECT path FROM blame LIMIT 2 * 3", "SELECT path FROM blame LIMIT '2'", "SELECT path FROM blame LIMIT 1.0"],
    "OFFSET takes a whole number": ["SELECT path FROM blame LIMIT 1 OFFSET NULL"],
}


@pytest.mark.parametrize(("what", "text"), [(what, text) for what, texts in WRONG.items() for text in texts])
def test_what_wrong_queries_are_told(what, text):
    found = trouble(text)
    assert found.sort is Sort.NAME and what in str(found) and found.at.line == 1


def test_reports():
    lines = trouble("SELECT path,\n  owner FROM blame").report().split("\n")
    assert lines == ["no such column: owner", "  at line 2, column 3", "  known here: path, line_no, line, commit_hash, author_name, author_email, authored_at"]
    assert str(trouble("SELECT 'x FROM blame")) == "a string without its closing quote"


def test_names():
    from tessera.plans.plan import output_names

    q = bind(parse('SELECT PATH, blame.LINE AS "X y", 1 + 1, * FROM Blame'), CATALOG)
    assert output_names(q.items)[:4] == ["path", "X y", "column_3", "path"]


@pytest.mark.parametrize(
    ("text", "lines"),
    [
        ("SELECT path FROM blame", ["Project (path)", "  Scan (none)"]),
        (
            "SELECT path, count(*) AS n FROM blame WHERE path LIKE 'src/%' AND line_no > 2 GROUP BY path HAVING n > 1 AND path <> 'x' ORDER BY 2 DESC, path LIMIT 3 OFFSET 1",
            [
                "Limit (3 OFFSET 1)", "  Project (path, count(*) AS n)", "    Sort (count(*) DESC, path ASC)", "      Filter (count(*) > 1)", "        Aggregate (group=[path], aggs=[count(*)])",
                "          Filter (path <> 'x')", "            Filter (path LIKE 'src/%' AND line_no > 2)", "              Scan (path LIKE 'src/%')",
            ],
        ),
        ("SELECT DISTINCT line FROM blame WHERE 1 = 1 AND 'a' = path", ["Distinct", "  Project (line)", "    ConstantGuard (1 = 1)", "      Filter (1 = 1 AND 'a' = path)", "        Scan ('a' = path)"]),
        ("SELECT 1 FROM blame WHERE line_no = '05' AND line_no > 4 AND path IN ('b', 'a')", ["Project (1)", "  ConstantGuard (5 > 4)", "    Filter (line_no = '05' AND 5 > 4 AND path IN ('b', 'a'))", "      Scan (path IN ('b', 'a'))"]),
        ("SELECT -(-line_no), (1 + 2) * 3, 1 - (2 - 3), NOT (path OR line AND 1) FROM blame", ["Project (-(-line_no), (1 + 2) * 3, 1 - (2 - 3), NOT (path OR (line AND 1)))", "  Scan (none)"]),
        ("SELECT count(*) FROM blame GROUP BY path HAVING 1 = 0 AND 0", ["Project (count(*))", "  Filter (0)", "    Aggregate (group=[path], aggs=[count(*)])", "      Scan (none)"]),
        ("SELECT CASE line WHEN 'a' THEN 1 END, CASE WHEN path = 'x' THEN 2 ELSE -line_no END + 1 FROM blame", ["Project (CASE line WHEN 'a' THEN 1 END, CASE WHEN path = 'x' THEN 2 ELSE -line_no END + 1)", "  Scan (none)"]),
        ("SELECT sum(line_no), 1 + sum(line_no) FROM blame", ["Project (sum(line_no), 1 + sum(line_no))", "  Aggregate (group=[], aggs=[sum(line_no)])", "    Scan (none)"]),
    ],
)
def test_plans(text, lines):
    assert plan_text(text).splitlines() == lines
