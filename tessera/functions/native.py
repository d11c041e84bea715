"""The dialect's expressions as Spark columns.

Spark types values by column, the dialect by cell. An expression's kind is known
statically but for numbers that may be integer or real from row to row (after an
overflow, or read from text): those are structs (i bigint, r double) of which one
is set. Integers carry bounds, so that plain arithmetic is used where overflow is
impossible. All stays in built-in expressions, except text of reals, numerals too
long for a cast, and LIKE with a pattern from the data, which are Arrow UDFs.

An expression that may raise (a bad ESCAPE) has a second column that says whether
it does, combined by the dialect's order of evaluation, so nothing depends on
when Spark evaluates what.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from enum import Enum
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import QueryError, Sort
from tessera.functions import values as V
from tessera.functions.numbers import real_to_text, text_to_real
from tessera.plans.syntax import COMPARISONS, And, Between, Binary, Case, Field, Fixed, In, Is, Like, Lit, Node, Not, Or, Sign, is_constant
from tessera.types import INT_MAX, INT_MIN, Affinity, Schema

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMERAL = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
#: A vertical tab must be written as a number in Java.
GAP = r"[ \t\n\x0B\f\r]*"
MARK = "[query error] "


class Kind(Enum):
    NULL = 0
    INT = 1
    REAL = 2
    NUM = 3  # integer or real by row
    TEXT = 4
    BOOL = 5
    ANY = 6  # number or text by row; only inside comparisons


NUMBERS = (Kind.INT, Kind.REAL, Kind.NUM)


@dataclass(frozen=True)
class Val:
    kind: Kind
    col: Column
    low: int = INT_MIN
    high: int = INT_MAX
    raised: Column | None = None
    const: bool = False
    value: V.Value = None
    stamp: Column | None = None  # the timestamp that the text is made of
    instant: bool = False  # whether that is a point in time, not a date and time without zone

    @property
    def i(self) -> Column:
        return self.col["i"] if self.kind in (Kind.NUM, Kind.ANY) else self.col if self.kind is Kind.INT else F.lit(None).cast("bigint")

    @property
    def r(self) -> Column:
        return self.col["r"] if self.kind in (Kind.NUM, Kind.ANY) else self.col if self.kind is Kind.REAL else F.lit(None).cast("double")

    @property
    def known(self) -> Column:
        """Whether the value isn't NULL."""
        if self.kind is Kind.NUM:
            return self.i.isNotNull() | self.r.isNotNull()
        return self.col.isNotNull()


def literal(v: V.Value) -> Val:
    if v is None:
        return Val(Kind.NULL, F.lit(None).cast("bigint"), const=True)
    if isinstance(v, int):
        return Val(Kind.INT, F.lit(v).cast("bigint"), v, v, const=True, value=v)
    return Val(Kind.REAL if isinstance(v, float) else Kind.TEXT, F.lit(v), const=True, value=v)


def any_of(*raised: Column | None) -> Column | None:
    some = [r for r in raised if r is not None]
    return reduce(lambda a, b: a | b, some) if some else None


def tree(parts: Sequence[Column], join: Callable[[Column, Column], Column]) -> Column:
    """A balanced tree, which Spark can walk however many parts there are."""
    parts = list(parts)
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


@F.pandas_udf(T.StringType())
def _real_text(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else real_to_text(v)).astype(object)


@F.pandas_udf(T.DoubleType())
def _long_numeral(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else text_to_real(v)).astype("float64")


@F.pandas_udf(T.BooleanType())
def _like(x: pd.Series, pattern: pd.Series, escape: pd.Series) -> pd.Series:
    """An escape of more than one character means none was written."""

    def one(a, p, e):
        if a is None or p is None or e is None:
            return None
        return V.like(a, p, e, True) if len(e) == 1 else V.like(a, p, None, False)

    return pd.Series([one(*t) for t in zip(x, pattern, escape, strict=True)], dtype=object)


def folded(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def num_struct(i: Column, r: Column) -> Column:
    return F.struct(i.alias("i"), r.alias("r"))


def real_of_numeral(t: Column) -> Column:
    """Numerals of up to 15 digits and small exponents are cast; others go by the model engine's own conversion."""
    short = t.rlike(r"^[+-]?(?=.{1,16}$)[0-9]*\.?[0-9]*(?:[eE][+-]?[0-9])?$")
    return F.when(short, t.try_cast("double")).otherwise(_long_numeral(F.when(~short, t)))


def parsed(t: Column, pattern: str) -> tuple[Column, Column, Column]:
    """The numeral that a pattern finds in text ('' if none), and its integer or real value."""
    found = F.regexp_extract(t, pattern, 1)
    whole = found.rlike(r"^[+-]?[0-9]+$")
    i = F.when(whole, found.try_cast("bigint"))
    return found, i, F.when(i.isNull() & (found != ""), real_of_numeral(found))


def number(v: Val) -> Val:
    """An operand of arithmetic: text counts as the number it begins with."""
    if v.kind is Kind.BOOL:
        return Val(Kind.INT, v.col.cast("bigint"), 0, 1, v.raised)
    if v.kind is not Kind.TEXT:
        return v
    if v.const:
        return literal(V.prefix_number(v.value))
    found, i, r = parsed(v.col, rf"^{GAP}({NUMERAL})")
    i = F.when(found == "", F.lit(0).cast("bigint")).otherwise(i)
    return Val(Kind.NUM, F.when(v.col.isNotNull(), num_struct(i, r)), raised=v.raised)


def double(v: Val) -> Column:
    return v.col if v.kind is Kind.REAL else v.col.cast("double") if v.kind is not Kind.NUM else F.coalesce(v.r, v.i.cast("double"))


def without_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def text_of(v: Val) -> Val:
    if v.kind is Kind.TEXT:
        return v
    if v.const:
        return literal(V.text(v.value))
    if v.kind is Kind.REAL:
        out = _real_text(v.col)
    elif v.kind is Kind.NUM:
        out = F.coalesce(v.i.cast("string"), _real_text(v.r))
    else:
        out = number(v).col.cast("string")
    return Val(Kind.TEXT, out, raised=v.raised)


def bounds(op: str, a: Val, b: Val) -> tuple[int, int]:
    if op == "+":
        return a.low + b.low, a.high + b.high
    if op == "-":
        return a.low - b.high, a.high - b.low
    ends = [x * y for x in (a.low, a.high) for y in (b.low, b.high)]
    return min(ends), max(ends)


_PLAIN = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / F.nullif(b, F.lit(0.0))}
_TRIED = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}


def divided(a: Val, b: Val) -> Column:
    by = F.nullif(b.col if b.kind is Kind.INT else b.i, F.lit(0).cast("bigint"))
    of = a.col if a.kind is Kind.INT else a.i
    safe = a.low > INT_MIN or b.low > -1 or b.high < -1
    quotient = F.call_function("div", of, by)
    return quotient if safe else F.when((of != INT_MIN) | (by != -1), quotient)


def arithmetic(op: str, a: Val, b: Val) -> Val:
    raised = any_of(a.raised, b.raised)
    if Kind.NULL in (a.kind, b.kind):
        return replace(literal(None), raised=raised)
    if op == "||":
        return Val(Kind.TEXT, F.concat(text_of(a).col, text_of(b).col), raised=raised)
    x, y = number(a), number(b)
    if op == "%":
        return remainder(a, b, x, y, raised)
    exact = None
    if Kind.REAL not in (x.kind, y.kind):
        if op == "/":
            exact = divided(x, y)
            if x.kind is y.kind is Kind.INT and (x.low > INT_MIN or y.low > -1 or y.high < -1):
                most = max(abs(x.low), abs(x.high))
                return Val(Kind.INT, exact, -min(most, INT_MAX), min(most, INT_MAX), raised)
        else:
            low, high = bounds(op, x, y)
            if x.kind is y.kind is Kind.INT and INT_MIN <= low and high <= INT_MAX:
                return Val(Kind.INT, _PLAIN[op](x.col, y.col), low, high, raised)
            exact = _TRIED[op](x.i, y.i)
    inexact = without_nan(_PLAIN[op](double(x), double(y)))
    if exact is None:
        return Val(Kind.REAL, inexact, raised=raised)
    if op == "/":  # two integers whose divisor is 0 give NULL, not a real
        zero = x.i.isNotNull() & (y.i == 0)
        inexact = F.when(~F.coalesce(zero, F.lit(False)), inexact)
    return Val(Kind.NUM, num_struct(exact, F.when(exact.isNull(), inexact)), raised=raised)


def whole_operand(v: Val, n: Val) -> Column:
    """What % reads: integers as they are, reals cut to 64 bits, of text the leading digits alone."""

    def cut(r: Column) -> Column:
        return F.when(r >= 2.0**63, INT_MAX).when(r <= -(2.0**63), INT_MIN).otherwise(F.when((r < 2.0**63) & (r > -(2.0**63)), r).cast("bigint"))

    if v.kind is Kind.TEXT and not v.const:
        digits = F.regexp_extract(v.col, rf"^{GAP}([+-]?[0-9]+)", 1)
        clamped = F.when(digits.startswith("-"), INT_MIN).otherwise(INT_MAX)
        return F.when(v.col.isNotNull(), F.when(digits == "", 0).otherwise(F.coalesce(digits.try_cast("bigint"), clamped))).cast("bigint")
    if v.const:
        return literal(V.remainder_operand(v.value)).col
    return n.col if n.kind is Kind.INT else cut(n.col) if n.kind is Kind.REAL else F.coalesce(n.i, cut(n.r))


def remainder(a: Val, b: Val, x: Val, y: Val, raised: Column | None) -> Val:
    i = F.try_mod(whole_operand(a, x), F.nullif(whole_operand(b, y), F.lit(0).cast("bigint")))
    if x.kind is y.kind is Kind.INT:
        most = min(max(abs(y.low), abs(y.high)), INT_MAX)
        return Val(Kind.INT, i, -most, most, raised)
    if Kind.REAL in (x.kind, y.kind):
        return Val(Kind.REAL, i.cast("double"), raised=raised)
    whole = x.i.isNotNull() & y.i.isNotNull()
    return Val(Kind.NUM, num_struct(F.when(whole, i), F.when(~whole, i.cast("double"))), raised=raised)


def negative(v: Val) -> Val:
    n = number(v)
    if n.kind is Kind.NULL:
        return n
    if n.kind is Kind.REAL:
        return replace(n, col=F.lit(0.0) - n.col, const=False)
    if n.kind is Kind.INT and n.low > INT_MIN:
        return Val(Kind.INT, -n.col, -n.high, -n.low, n.raised)
    i = F.try_subtract(F.lit(0).cast("bigint"), n.i)
    return Val(Kind.NUM, num_struct(i, F.when(i.isNull(), F.lit(0.0) - double(n))), raised=n.raised)


# -- comparisons


def number_key(i: Column, r: Column) -> tuple[Column, Column]:
    """(hi, lo) by which integers and reals sort and compare exactly."""
    d = i.cast("double")
    rest = F.when(d == 2.0**63, (i - INT_MAX) - 1).otherwise(i - F.when(d < 2.0**63, d).cast("bigint"))
    return F.coalesce(r, d), F.coalesce(rest, F.lit(0).cast("bigint"))


def key(v: Val) -> Column:
    """A struct that sorts and compares as the values of any kind do; null for NULL."""
    if v.kind is Kind.BOOL:
        v = number(v)
    if v.kind is Kind.TEXT:
        return F.when(v.col.isNotNull(), F.struct(F.lit(2).alias("k"), F.lit(0.0).alias("h"), F.lit(0).cast("bigint").alias("l"), v.col.alias("t")))
    hi, lo = number_key(v.i, v.r)
    plain = F.struct(F.lit(1).alias("k"), hi.alias("h"), lo.alias("l"), F.lit("").alias("t"))
    if v.kind is Kind.ANY:
        words = F.struct(F.lit(2).alias("k"), F.lit(0.0).alias("h"), F.lit(0).cast("bigint").alias("l"), v.col["t"].alias("t"))
        return F.when(v.i.isNotNull() | v.r.isNotNull(), plain).otherwise(F.when(v.col["t"].isNotNull(), words))
    return F.when(v.known, plain)


def sort_key(v: Val) -> Column:
    return key(v) if v.kind is Kind.NUM else v.col


def as_number_if_whole(v: Val) -> Val:
    """What a numeric column makes of the other operand."""
    if v.kind is not Kind.TEXT:
        return v
    if v.const:
        return literal(V.stored(v.value, Affinity.INTEGER))
    _, i, r = parsed(v.col, rf"^{GAP}({NUMERAL}){GAP}\z")
    words = F.when(i.isNull() & r.isNull(), v.col)
    return Val(Kind.ANY, F.struct(i.alias("i"), r.alias("r"), words.alias("t")), raised=v.raised)


def matched(a: Val, b: Val, of_a: Affinity | None, of_b: Affinity | None) -> tuple[Val, Val]:
    if of_a in V.NUMERIC and of_b not in V.NUMERIC:
        return a, as_number_if_whole(b)
    if of_b in V.NUMERIC and of_a not in V.NUMERIC:
        return as_number_if_whole(a), b
    if of_a is Affinity.TEXT and of_b is None and b.kind is not Kind.NULL:
        return a, text_of(b)
    if of_b is Affinity.TEXT and of_a is None and a.kind is not Kind.NULL:
        return text_of(a), b
    return a, b


_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
_TURNED = {"=": "=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def certain(known: Column, value: bool) -> Column:
    return F.when(known, F.lit(value))


def integer_against(op: str, a: Val, x: float) -> Column:
    """An integer column against a real constant, as a comparison of integers that a scan can use."""
    if x >= 2.0**63 or x < -(2.0**63):
        return certain(a.known, op == "<>" or (op[0] == "<") == (x > 0) and op != "=")
    below = int(x // 1)
    if below == x:
        return _OPS[op](a.col, F.lit(below).cast("bigint"))
    if op in ("=", "<>"):
        return certain(a.known, op == "<>")
    return a.col <= F.lit(below).cast("bigint") if op[0] == "<" else a.col > F.lit(below).cast("bigint")


def iso_text(stamp: Column, instant: bool) -> Column:
    """ISO text in UTC of a timestamp; the session's time zone plays no part."""
    if not instant:
        plain = stamp.cast("string")
        return F.concat(F.substring(plain, 1, 10), F.lit("T"), F.substring(plain, 12, 8), F.lit("Z"))
    seconds = F.unix_seconds(stamp)
    of_day = F.pmod(seconds, F.lit(86400))
    day = F.date_from_unix_date(((seconds - of_day) / 86400).cast("int")).cast("string")
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), two(of_day / 3600), F.lit(":"), two(of_day % 3600 / 60), F.lit(":"), two(of_day % 60), F.lit("Z"))


def stamp_against(op: str, stamp: Column, text: str, instant: bool) -> Column:
    """ISO text of a timestamp against a text constant, as a comparison of timestamps that a scan can use."""
    first, last = datetime(1, 1, 1), datetime(9999, 12, 31, 23, 59, 59)
    iso = lambda k: (first + timedelta(seconds=k)).strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
    low, high = 0, int((last - first).total_seconds()) + 1
    while low < high:  # the first second whose text isn't less
        middle = (low + high) // 2
        low, high = (middle + 1, high) if iso(middle) < text else (low, middle)
    if low > (last - first).total_seconds():
        return certain(stamp.isNotNull(), op in ("<", "<=", "<>"))
    same = iso(low) == text
    seconds = int((first - datetime(1970, 1, 1)).total_seconds()) + low
    told = lambda k: F.timestamp_seconds(F.lit(seconds + k)) if instant else F.lit((first + timedelta(seconds=low + k)).isoformat(" ").rjust(19, "0")).cast("timestamp_ntz")
    at, after = told(0), told(same)
    if op in ("=", "<>"):
        if not same:
            return certain(stamp.isNotNull(), op == "<>")
        inside = (stamp >= at) & (stamp < after)
        return inside if op == "=" else ~inside
    return {"<": stamp < at, "<=": stamp < after, ">": stamp >= after, ">=": stamp >= at}[op]


def comparison(op: str, a: Val, b: Val, of_a: Affinity | None = None, of_b: Affinity | None = None) -> Column:
    a, b = matched(a, b, of_a, of_b)
    if Kind.NULL in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    a, b = (number(v) if v.kind is Kind.BOOL else v for v in (a, b))
    if a.const and not b.const:
        a, b, op = b, a, _TURNED[op]
    if a.stamp is not None and b.const and b.kind is Kind.TEXT:
        return stamp_against(op, a.stamp, b.value, a.instant)
    if a.kind is b.kind and a.kind in (Kind.INT, Kind.REAL, Kind.TEXT):
        return _OPS[op](a.col, b.col)
    if b.const and a.kind is Kind.INT and b.kind is Kind.REAL:
        return integer_against(op, a, b.value)
    if b.const and a.kind is Kind.REAL and b.kind is Kind.INT and int(float(b.value)) == b.value:
        return _OPS[op](a.col, F.lit(float(b.value)))
    if Kind.TEXT in (a.kind, b.kind) and (a.kind in NUMBERS or b.kind in NUMBERS):
        less = b.kind is Kind.TEXT  # a number is less than any text
        return certain(a.known & b.known, {"=": False, "<>": True}.get(op, (op[0] == "<") == less))
    return _OPS[op](key(a), key(b))


def same(a: Val, b: Val, of_a: Affinity | None, of_b: Affinity | None) -> Column:
    """IS: NULLs are the same."""
    a, b = matched(a, b, of_a, of_b)
    if Kind.NULL in (a.kind, b.kind):
        other = b if a.kind is Kind.NULL else a
        return F.lit(True) if other.kind is Kind.NULL else F.coalesce(key(other), F.lit(None)).isNull() if other.kind is Kind.ANY else ~other.known
    a, b = (number(v) if v.kind is Kind.BOOL else v for v in (a, b))
    if a.kind is b.kind and a.kind in (Kind.INT, Kind.REAL, Kind.TEXT):
        return a.col.eqNullSafe(b.col)
    return key(a).eqNullSafe(key(b))


def truth(v: Val) -> Column:
    if v.kind is Kind.BOOL:
        return v.col
    if v.kind is Kind.NULL:
        return F.lit(None).cast("boolean")
    n = number(v)
    return (n.col != 0) if n.kind is not Kind.NUM else F.coalesce(n.i != 0, n.r != 0)


def like(x: Val, pattern: Val, escape: Val | None) -> Column:
    if Kind.NULL in (x.kind, pattern.kind) or escape is not None and escape.kind is Kind.NULL:
        return F.lit(None).cast("boolean")
    subject = text_of(x).col
    if not pattern.const or escape is not None and not escape.const:
        sign = text_of(escape).col if escape is not None else F.lit("none")
        return _like(subject, text_of(pattern).col, sign)
    p, e = V.text(pattern.value), V.text(escape.value) if escape is not None else None
    if e is not None and len(e) != 1:
        return F.lit(None).cast("boolean")  # it raises
    made = V.like_pattern(p, e)
    if made is None:
        return certain(subject.isNotNull(), False)
    plain = V.fold(p.strip("%"))
    if e is None and not set("%_") & set(plain):
        left, right = p.startswith("%"), p.endswith("%")
        if not plain:
            return certain(subject.isNotNull(), True) if p else subject == ""
        low = folded(subject)
        return low.contains(plain) if left and right else low.endswith(plain) if left else low.startswith(plain) if right else low == plain
    return folded(subject).rlike(rf"(?s)\A(?:{_java(p, e)})\z")


def _java(pattern: str, escape: str | None) -> str:
    """A LIKE pattern as a Java regular expression; every literal character is written as a number."""
    out, it = [], iter(pattern)
    for c in it:
        if c == escape:
            out.append(rf"\x{{{ord(V.fold(next(it))):x}}}")
        else:
            out.append(".*" if c == "%" else "." if c == "_" else rf"\x{{{ord(V.fold(c)):x}}}")
    return "".join(out)


# -- rows


_KIND = {Affinity.TEXT: Kind.TEXT, Affinity.INTEGER: Kind.INT, Affinity.REAL: Kind.REAL}


def cells(schema: Schema, types: Mapping[str, str], first: int = 0) -> list[Val]:
    """The values of a table's columns, which are named c0, c1, ... from ``first`` on; ``types`` are Spark's by name."""
    row = []
    for i, c in enumerate(schema.columns, first):
        own = F.col(f"c{i}")
        if c.refused:
            row.append(literal(None))
        elif c.iso:
            instant = types[f"c{i}"] == "timestamp"
            row.append(Val(Kind.TEXT, iso_text(own, instant), stamp=own, instant=instant))
        else:
            row.append(Val(_KIND[c.affinity], own, c.low, c.high))
    return row


def equal(a: Val, b: Val, of_a: Affinity | None, of_b: Affinity | None) -> Column:
    """Equality of two columns in a form that Spark can join by: the values themselves, or the keys that values of any kind compare by."""
    a, b = matched(a, b, of_a, of_b)
    plain = a.kind is b.kind and a.kind in (Kind.INT, Kind.REAL, Kind.TEXT)
    return a.col == b.col if plain else key(a) == key(b)


# -- whole expressions


class Compiler:
    """Expressions over an input row, given as a value for each of its columns."""

    def __init__(self, row: Sequence[Val], schema: Schema) -> None:
        self.row, self.schema = row, schema

    def affinity(self, n: Node) -> Affinity | None:
        return V.affinity_of(n, self.schema)

    def value(self, n: Node) -> Val:
        if is_constant(n) and not isinstance(n, Fixed):
            try:
                return literal(V.Constant(self.schema).value(n))
            except QueryError:
                return replace(literal(None), raised=F.lit(True))
        match n:
            case Lit() | Fixed():
                return literal(n.value)
            case Field():
                return self.row[n.index]
            case Sign():
                x = self.value(n.x)
                return x if n.op == "+" else negative(x)
            case Binary() if n.op not in COMPARISONS:
                return arithmetic(n.op, self.value(n.a), self.value(n.b))
            case And() | Or():
                return self.joined(n, self.value)
            case Not():
                x = self.value(n.x)
                return Val(Kind.BOOL, ~truth(x), raised=x.raised)
            case Case():
                return self.case(n)
        return self.predicate(n)

    def case(self, n: Case) -> Val:
        """The first branch that holds; what comes after it doesn't raise. All results are numbers, or all are text."""
        x = self.value(n.x) if n.x is not None else None
        raised, open_, chosen = x.raised if x else None, F.lit(True), []
        for when, result in n.branches:
            if x is None:
                test = self.condition(when)
            else:
                y = self.value(when)
                test = Val(Kind.BOOL, comparison("=", x, y, self.affinity(n.x), self.affinity(when)), raised=y.raised)
            hit, out = F.coalesce(test.col, F.lit(False)), self.value(result)
            if test.raised is not None:
                raised = any_of(raised, open_ & test.raised)
            if out.raised is not None:
                raised = any_of(raised, open_ & hit & out.raised)
            open_ = open_ & ~hit
            chosen.append((hit, out))
        last = self.value(n.other) if n.other is not None else literal(None)
        if last.raised is not None:
            raised = any_of(raised, open_ & last.raised)
        outs = [number(v) if v.kind is Kind.BOOL else v for v in (*[v for _, v in chosen], last)]
        some = [v for v in outs if v.kind is not Kind.NULL]
        kinds = {v.kind for v in some}
        if not kinds:
            return replace(literal(None), const=False, raised=raised)
        if Kind.TEXT in kinds and len(kinds) > 1:
            raise QueryError(Sort.OMITTED, "no CASE with text in one branch and a number in another", n.at)
        kind = kinds.pop() if len(kinds) == 1 else Kind.NUM
        own = (lambda v: F.when(v.known, num_struct(v.i, v.r))) if kind is Kind.NUM else lambda v: v.col
        none = F.lit(None)
        col = none if outs[-1].kind is Kind.NULL else own(outs[-1])
        for (hit, _), v in reversed(list(zip(chosen, outs[:-1], strict=True))):
            col = F.when(hit, none if v.kind is Kind.NULL else own(v)).otherwise(col)
        return Val(kind, col, min(v.low for v in some), max(v.high for v in some), raised=raised)

    def joined(self, n: And | Or, of: Callable[[Node], Val]) -> Val:
        """All operands of a chain of the same operator."""
        parts, todo = [], [n]
        while todo:
            x = todo.pop()
            if type(x) is type(n) and not is_constant(x):
                todo += [x.b, x.a]
            else:
                parts.append(of(x))
        join = (lambda a, b: a & b) if isinstance(n, And) else (lambda a, b: a | b)
        return Val(Kind.BOOL, tree([truth(p) for p in parts], join), raised=any_of(*[p.raised for p in parts]))

    def predicate(self, n: Node) -> Val:
        match n:
            case Binary():
                a, b = self.value(n.a), self.value(n.b)
                return Val(Kind.BOOL, comparison(n.op, a, b, self.affinity(n.a), self.affinity(n.b)), raised=any_of(a.raised, b.raised))
            case Is():
                a, b = self.value(n.a), self.value(n.b)
                out = same(a, b, self.affinity(n.a), self.affinity(n.b))
                return Val(Kind.BOOL, ~out if n.negated else out, raised=any_of(a.raised, b.raised))
            case Like():
                x, p = self.value(n.x), self.value(n.pattern)
                e = self.value(n.escape) if n.escape is not None else None
                bad = None
                if e is not None and e.const and e.kind is not Kind.NULL:
                    bad = F.lit(True) if len(V.text(e.value)) != 1 else None
                elif e is not None and not e.const:
                    bad = F.coalesce(F.length(text_of(e).col) != 1, F.lit(False))
                out = like(x, p, e)
                return Val(Kind.BOOL, ~out if n.negated else out, raised=any_of(x.raised, p.raised, e.raised if e else None, bad))
            case In():
                return self.listed(n)
            case Between():
                x, low, high = (self.value(m) for m in (n.x, n.low, n.high))
                of = self.affinity(n.x)
                out = comparison(">=", x, low, of, self.affinity(n.low)) & comparison("<=", x, high, of, self.affinity(n.high))
                return Val(Kind.BOOL, ~out if n.negated else out, raised=any_of(x.raised, low.raised, high.raised))
        raise TypeError(f"no column for {type(n).__name__}")

    def listed(self, n: In) -> Val:
        x = self.value(n.x)
        if not n.items:
            return Val(Kind.BOOL, F.lit(n.negated), raised=x.raised)
        items = [self.value(m) for m in n.items]
        of = self.affinity(n.x)
        pairs = [matched(x, m, of, None) for m in items]
        raised = x.raised
        if x.stamp is None and all(a is x and b.const and b.kind is x.kind and b.kind in (Kind.INT, Kind.TEXT) for a, b in pairs):
            out = x.col.isin([b.value for _, b in pairs])
        else:
            tests = [comparison("=", x, m, of, None) for m in items]
            out = tree(tests, lambda a, b: a | b)
            for m, before in zip(items, range(len(items)), strict=True):
                if m.raised is not None:  # only reached if nothing before it is equal
                    hit = [F.coalesce(t, F.lit(False)) for t in tests[:before]]
                    raised = any_of(raised, m.raised & ~tree(hit, lambda a, b: a | b) if hit else m.raised)
        return Val(Kind.BOOL, ~out if n.negated else out, raised=raised)

    def condition(self, n: Node, plain: bool = True) -> Val:
        """As a condition: what stands after a deciding operand doesn't raise."""
        if is_constant(n):
            try:
                out = V.Constant(self.schema).condition(n, plain)
                return Val(Kind.BOOL, F.lit(out).cast("boolean"))
            except QueryError:
                return Val(Kind.BOOL, F.lit(None).cast("boolean"), raised=F.lit(True))
        match n:
            case And() | Or():
                return self.decided(n, plain)
            case Not():
                x = self.condition(n.x, not plain)
                return Val(Kind.BOOL, ~x.col, raised=x.raised)
            case In() if not n.items:
                return Val(Kind.BOOL, F.lit(n.negated))
            case Between():
                x, low, high = (self.value(m) for m in (n.x, n.low, n.high))
                if high.raised is not None:
                    first = comparison(">=", x, low, self.affinity(n.x), self.affinity(n.low))
                    reached = F.coalesce(first, F.lit(plain is n.negated))
                    out = self.predicate(n)
                    return replace(out, raised=any_of(x.raised, low.raised, high.raised & reached))
        v = self.value(n)
        return Val(Kind.BOOL, truth(v), raised=v.raised)

    def decided(self, n: And | Or, plain: bool) -> Val:
        if (known := V.settled(n)) is not None:
            return Val(Kind.BOOL, F.lit(known))
        ending = isinstance(n, Or)
        for one, other in ((n.a, n.b), (n.b, n.a)):
            if V.settled(other) is (not ending):
                return self.condition(one, plain)
        a, b = self.condition(n.a, plain), self.condition(n.b, plain)
        raised = a.raised
        if b.raised is not None:
            # a NULL on the left counts as FALSE under an even number of NOTs, else as TRUE
            left = F.coalesce(a.col, F.lit(not plain))
            raised = any_of(raised, b.raised & (~left if ending else left))
        if a.raised is None and b.raised is None:
            return self.joined(n, lambda m: self.condition(m, plain))
        return Val(Kind.BOOL, a.col | b.col if ending else a.col & b.col, raised=raised)


def raise_if(raised: Column, otherwise: Column, message: str = V.BAD_ESCAPE) -> Column:
    return F.when(raised, F.raise_error(F.lit(MARK + message)).cast("boolean")).otherwise(otherwise)
