"""Places of regular-expression matches, as native expressions.

Spark copies an accumulator at each step of ``aggregate``, so gathering spans in
one takes the square of their number. What runs along an array is therefore
scanned by doubling: in round k each element is combined with the one 2**k before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.llm.common import let

PLACE = "array<struct<start:int,end:int>>"
SPAN = "array<struct<start:int,end:int,hit:string,part:string>>"


def scanned(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Each element combined with all before it; ``combine`` is associative. Work is n log n."""

    def whole(v: Column) -> Column:
        # bin() has as many digits as rounds are needed
        rounds = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.size(v) - 1)) - 1), lambda k: F.call_function("shiftleft", F.lit(1), k))
        return F.aggregate(rounds, v, lambda acc, far: F.transform(acc, lambda x, i: F.when(i >= far, combine(F.get(acc, i - far), x)).otherwise(x)))

    return let(values, lambda v: F.when(F.size(v) > 1, whole(v)).otherwise(v))


def find(text: Column, pattern: str, group: int = 0, hint: str | None = None) -> Column:
    """Leftmost non-overlapping matches: start and end in code points (end exclusive), the match, and the given group.

    Spark tells what matched, not where. Splitting at the same pattern gives the
    text between matches, and the lengths of both, summed in order, the places.
    Texts without a match (or without ``hint``, a pattern that any match implies)
    are only searched once.
    """

    def placed(z: Column) -> Column:
        def of(ends: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                end = F.get(ends, i)
                return F.struct((end - F.length(x["hit"])).alias("start"), end.alias("end"), x["hit"].alias("hit"), x["part" if group else "hit"].alias("part"))

            return F.transform(z, span)

        return let(scanned(F.transform(z, lambda x: F.length(x["gap"]) + F.length(x["hit"])), lambda a, b: a + b), of)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part")] if group else []
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(hits.alias("hit"), *parts, F.slice(gaps, F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(0))).alias("gap"))
    return F.when(F.coalesce(text.rlike(hint or pattern), F.lit(False)), let(zipped, placed)).otherwise(F.array().cast(SPAN))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each of the ascending, disjoint spans (start, end, new) replaced."""

    def build(s: Column) -> Column:
        chars, at = s["chars"], s["spans"]
        kept = lambda a, b: F.array_join(F.slice(chars, a + 1, F.greatest(b - a, F.lit(0))), "")
        parts = F.transform(at, lambda x, i: F.concat(kept(F.coalesce(F.get(at, i - 1)["end"], F.lit(0)), x["start"]), x["new"]))
        rest = kept(F.element_at(at, -1)["end"], F.size(chars))
        return F.concat(F.array_join(parts, ""), rest)

    return F.when(F.size(spans) > 0, let(F.struct(F.split(text, "").alias("chars"), spans.alias("spans")), build)).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of ascending, disjoint spans; places stay."""
    return replaced(text, F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.repeat(F.lit(" "), x["end"] - x["start"]).alias("new"))))


def merged(spans: Column) -> Column:
    """(start, end) of what spans sorted by start cover: those that overlap become one."""

    def of(s: Column) -> Column:
        def cut(far: Column) -> Column:  # the furthest end up to each span
            begins = F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(far, i - 1)), x["start"]))
            ends = F.transform(far, lambda e, i: F.when((i == F.size(s) - 1) | (F.get(s, i + 1)["start"] >= e), e))
            return F.arrays_zip(F.array_compact(begins).alias("start"), F.array_compact(ends).alias("end"))

        return let(scanned(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), cut)

    return F.when(F.size(spans) > 0, let(spans, of)).otherwise(F.array()).cast(PLACE)
