"""The five aggregates.

Partial aggregation is Spark's. Integer sums are exact and raise when they leave
64 bits; over rows with an order, as soon as a running sum does. Sums of reals are
compensated in row order where rows have one; that gathers a group's values in one
row, so for tables without an order (and for ``sums='fast'``) Spark's own sum is
used, whose last bits depend on the partitions.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.native import GAP, MARK, NUMERAL, Kind, Val, double, key, literal, num_struct, number, parsed, without_nan
from tessera.functions.values import prefix_number, whole_number
from tessera.sources.base import ROW_ID
from tessera.types import INT_MAX, INT_MIN

OVERFLOW = "integer overflow computing sum(...)"
#: More rows than any table has; counts, and sums of small numbers, are bounded by it.
MOST_ROWS = 1 << 52


def summand(v: Val) -> Val:
    """Text is an integer only if all of it is one; its value is that of the number it begins with."""
    if v.kind is not Kind.TEXT:
        return number(v)
    if v.const:
        whole = whole_number(v.value)
        return literal(whole if isinstance(whole, int) else float(prefix_number(v.value)))
    _, i, _ = parsed(v.col, rf"^{GAP}({NUMERAL}){GAP}\z")
    start = number(v)
    return Val(Kind.NUM, F.when(v.col.isNotNull(), num_struct(i, F.when(i.isNull(), double(start)))), raised=v.raised)


def overflow() -> Column:
    return F.raise_error(F.lit(MARK + OVERFLOW)).cast("bigint")


def in_order(v: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(F.col(ROW_ID).alias("o"), v.alias("v")))))


def exact_sum(i: Column, ordered: bool, small: bool) -> Column:
    """A sum of integers, NULL for none, or an error."""
    if small:  # narrow types: only the total can leave 64 bits
        total = F.try_sum(i)
        return F.when(total.isNull() & (F.count(i) > 0), overflow()).otherwise(total)
    total = F.sum(i.cast("decimal(38,0)"))
    fits = (total >= F.lit(INT_MIN).cast("decimal(38,0)")) & (total <= F.lit(INT_MAX).cast("decimal(38,0)"))
    plain = F.when(fits | total.isNull(), total.try_cast("bigint")).otherwise(overflow())
    if not ordered:
        return plain
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(False).alias("bad"))
    step = lambda a, x: F.struct(F.coalesce(F.try_add(a["s"], x["v"]), F.lit(0).cast("bigint")).alias("s"), (a["bad"] | F.try_add(a["s"], x["v"]).isNull()).alias("bad"))
    ran = F.aggregate(in_order(i), zero, step)
    return F.when(F.count(i) == 0, None).when(ran["bad"], overflow()).otherwise(ran["s"])


def compensated(r: Column) -> Column:
    """A sum that carries the rounding errors of its additions along, in row order."""

    def step(a: Column, x: Column) -> Column:
        t = a["s"] + x["v"]
        lost = F.when(F.abs(a["s"]) > F.abs(x["v"]), (a["s"] - t) + x["v"]).otherwise((x["v"] - t) + a["s"])
        return F.struct(t.alias("s"), (a["c"] + lost).alias("c"))

    def finish(a: Column) -> Column:
        usable = ~F.isnan(a["c"]) & (F.abs(a["c"]) != float("inf"))
        return F.when(usable, a["s"] + a["c"]).otherwise(a["s"])

    return F.aggregate(in_order(r), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), step, finish)


def real_sum(r: Column, ordered: bool) -> Column:
    return F.when(F.count(r) > 0, without_nan(compensated(r) if ordered else F.sum(r)))


def is_small(v: Val) -> bool:
    return v.kind is Kind.INT and abs(v.low) <= 1 << 32 and abs(v.high) <= 1 << 32


def short(text: Column) -> Column:
    """Text that stands for itself, or for longer ones their digest with a mark, so that long texts aren't shuffled to be told apart."""
    return F.when(F.octet_length(text) <= 64, text).otherwise(F.concat(F.lit("sha256:"), F.sha2(text, 256)))


def compute(name: str, v: Val | None, distinct: bool, ordered: bool) -> Val:
    """An aggregate over an argument; v is None for count(*)."""
    if name == "count":
        if v is None:
            return Val(Kind.INT, F.count(F.lit(1)), 0, MOST_ROWS)
        if v.kind is Kind.NULL:
            return Val(Kind.INT, F.count(F.lit(None)), 0, MOST_ROWS)
        if distinct:
            return Val(Kind.INT, F.count_distinct(key(v) if v.kind is Kind.NUM else short(v.col) if v.kind is Kind.TEXT else v.col), 0, MOST_ROWS)
        return Val(Kind.INT, F.count(F.when(v.known, 1)) if v.kind is Kind.NUM else F.count(v.col), 0, MOST_ROWS)
    if v.kind is Kind.NULL:
        return Val(Kind.NULL, F.max(F.lit(None).cast("bigint")))
    if name in ("min", "max"):
        return extreme(name, v, ordered)
    if distinct:
        return over_distinct(name, v)
    n = summand(v)
    if n.kind is Kind.REAL:
        total = real_sum(n.col, ordered)
        return Val(Kind.REAL, total if name == "sum" else total / F.nullif(F.count(n.col), F.lit(0)))
    if name == "sum" and n.kind is Kind.INT:
        low, high = max(INT_MIN, min(0, n.low) * MOST_ROWS), min(INT_MAX, max(0, n.high) * MOST_ROWS)
        return Val(Kind.INT, exact_sum(n.col, ordered, is_small(n)), low, high)
    count = F.count(n.i) + F.count(n.r) if n.kind is Kind.NUM else F.count(n.col)
    if n.kind is Kind.INT:  # avg never raises
        exact = F.sum(n.col.cast("decimal(38,0)")) if not is_small(n) else F.try_sum(n.col)
        return Val(Kind.REAL, exact.cast("double") / F.nullif(count, F.lit(0)))
    total = real_sum(double(n), ordered)
    if name == "avg":
        return Val(Kind.REAL, total / F.nullif(count, F.lit(0)))
    whole = F.count(n.r) == 0
    return Val(Kind.NUM, num_struct(F.when(whole, exact_sum(n.i, ordered, False)), F.when(~whole, total)))


def over_distinct(name: str, v: Val) -> Val:
    """sum and avg of different values; text is told apart as text, before it's read as a number."""
    if v.kind in (Kind.INT, Kind.BOOL):
        n = number(v)
        total = F.sum_distinct(n.col.cast("decimal(38,0)"))
        if name == "avg":
            return Val(Kind.REAL, total.cast("double") / F.nullif(F.count_distinct(n.col), F.lit(0)))
        fits = (total >= F.lit(INT_MIN).cast("decimal(38,0)")) & (total <= F.lit(INT_MAX).cast("decimal(38,0)"))
        return Val(Kind.INT, F.when(fits | total.isNull(), total.try_cast("bigint")).otherwise(overflow()))
    if v.kind is Kind.REAL:
        total = without_nan(F.sum_distinct(v.col))
        return Val(Kind.REAL, total if name == "sum" else total / F.nullif(F.count_distinct(v.col), F.lit(0)))
    n = summand(v)
    values = F.collect_set(F.when(v.known, F.struct(v.col.alias("own"), n.i.alias("i"), n.r.alias("r"))))
    size = F.nullif(F.size(values), F.lit(0))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x["r"], x["i"].cast("double")))
    total = F.when(F.size(values) > 0, total)
    if name == "avg":
        return Val(Kind.REAL, total / size)
    exact = F.aggregate(values, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + F.coalesce(x["i"].cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)"))
    whole = ~F.exists(values, lambda x: x["r"].isNotNull())
    i = F.when(whole & (F.size(values) > 0), F.coalesce(exact.try_cast("bigint"), overflow()))
    return Val(Kind.NUM, num_struct(i, F.when(~whole, total)))


def extreme(name: str, v: Val, ordered: bool) -> Val:
    """Of equal values that look different (1 and 1.0, 0.0 and -0.0) the first counts where rows have an order."""
    v = number(v) if v.kind is Kind.BOOL else v
    if v.kind in (Kind.INT, Kind.TEXT):
        return replace(v, col=F.min(v.col) if name == "min" else F.max(v.col), const=False, raised=None, stamp=None)
    k = key(v) if v.kind is Kind.NUM else v.col
    if not ordered:
        by = F.min_by(v.col, k) if name == "min" else F.max_by(v.col, k)
        return replace(v, col=by if v.kind is Kind.NUM else (F.min(v.col) if name == "min" else F.max(v.col)), const=False, raised=None)
    if name == "min":
        return replace(v, col=F.min_by(v.col, F.when(v.known, F.struct(k.alias("k"), F.col(ROW_ID).alias("o")))), const=False, raised=None)
    # the greatest, and of equal ones the first: the least of the negated key
    falling = [-k["h"], -k["l"]] if v.kind is Kind.NUM else [-k]
    by = F.struct(*[x.alias(f"k{i}") for i, x in enumerate(falling)], F.col(ROW_ID).alias("o"))
    return replace(v, col=F.min_by(v.col, F.when(v.known, by)), const=False, raised=None)
