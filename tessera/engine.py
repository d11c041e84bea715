"""Queries of the dialect, run by Spark."""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator, Mapping
from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import QueryError, Sort as Trouble, SourceError
from tessera.functions.native import MARK, Compiler, Kind, Val, cells, double, key, num_struct, number, raise_if, sort_key, tree
from tessera.functions.values import Constant, Value
from tessera.operators.aggregates import compute
from tessera.operators.joins import JoinedTable
from tessera.plans.binder import Bound, bind
from tessera.plans.parser import parse
from tessera.plans.plan import Aggregate, Distinct, Filter, Guard, Limit, Op, Project, Scan, Sort, aggregate_schema, chain, explain, output_names, plan, push_down, sql
from tessera.plans.syntax import Node, Star
from tessera.sources.base import ROW_ID, Table
from tessera.types import Affinity, Schema, fold

_SPARK = {Affinity.TEXT: "string", Affinity.INTEGER: "bigint", Affinity.REAL: "double"}


@contextlib.contextmanager
def deep() -> Iterator[None]:
    """Room for the recursion that trees of the greatest height need."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 40_000))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


class Query:
    """A planned query; nothing runs before rows are asked for."""

    def __init__(self, engine: Engine, bound: Bound, op: Op, table: Table) -> None:
        self.engine, self.bound, self.op, self.table = engine, bound, op, table

    @property
    def names(self) -> list[str]:
        return output_names(self.bound.items)

    def explain(self) -> str:
        def line(scan: Scan) -> str:
            terms = ", ".join(map(sql, scan.pushed)) or "none"
            e = self.table.estimate(scan.pushed)
            if e is None:
                return f"{scan.table} (pushed: {terms})" if scan.pushed else f"{scan.table} (pushed by Catalyst)"
            return f"{e.name} (pushed: {terms} -> {e.selected} of {e.total} {e.unit})"

        with deep():
            return explain(self.op, line)

    def frame(self, mixed: str = "struct") -> DataFrame:
        """The result. A column of numbers that may be integer or real by row is a struct (i, r), or with mixed='double' a double."""
        with deep():
            return _Build(self.engine.spark, self.table, self.op, self.names).result(mixed)

    def rows(self) -> list[tuple[Value, ...]]:
        try:
            got = self.frame().collect()
        except PySparkException as e:
            text = str(e)
            if MARK in text:
                raise QueryError(Trouble.VALUE, text.split(MARK, 1)[1].split("\n")[0].split(" SQLSTATE")[0].strip()) from e
            if SourceError.__name__ in text:
                raise SourceError(text) from e
            raise

        def plain(v):
            return v if not isinstance(v, tuple) else v["i"] if v["i"] is not None else v["r"]

        return [tuple(plain(v) for v in row) for row in got]


class Engine:
    """Runs the dialect over a catalog of tables."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, Table]) -> None:
        self.spark, self.tables = spark, dict(tables)

    def query(self, text: str, pushdown: bool = True) -> Query:
        with deep():
            bound = bind(parse(text), {n: t.schema for n, t in self.tables.items()})
            op = plan(bound)
            every = [self.tables[s.table] for s in bound.sources]
            table = every[0] if len(every) == 1 else JoinedTable(bound.schema, bound.sources, every)
            if pushdown:
                push_down(op, table.accepts)
        return Query(self, bound, op, table)

    def frame(self, text: str) -> DataFrame:
        return self.query(text).frame()

    def rows(self, text: str) -> list[tuple[Value, ...]]:
        return self.query(text).rows()


class _Build:
    """Walks a plan from the scan up. The frame's columns are only reached through ``row``."""

    def __init__(self, spark: SparkSession, table: Table, op: Op, names: list[str]) -> None:
        self.spark, self.table, self.names = spark, table, names
        self.ops = list(reversed(chain(op)))
        self.schema: Schema = table.schema

    @property
    def compiler(self) -> Compiler:
        return Compiler(self.row, self.schema)

    def result(self, mixed: str) -> DataFrame:
        limit = next((x for x in self.ops if isinstance(x, Limit)), None)
        nothing = limit is not None and limit.limit == 0 or not self.guard_holds()
        # the first rows will do if nothing above the scan has to see all
        few = limit is not None and limit.limit >= 0 and not any(isinstance(x, Aggregate | Sort | Distinct) for x in self.ops)
        self.scan(self.ops[0], nothing, few)
        for x in self.ops[1:]:
            match x:
                case Filter():
                    self.filter(x)
                case Aggregate():
                    self.aggregate(x)
                case Sort():
                    self.sort(x)
                case Project():
                    self.project(x)
                case Distinct():
                    self.distinct()
        return self.finish(limit, mixed)

    def guard_holds(self) -> bool:
        """Decides the constant terms, in order, up to the first that isn't TRUE; may raise."""
        terms = next((x.terms for x in self.ops if isinstance(x, Guard)), [])
        constant = Constant(self.schema)
        return all(constant.condition(t) is True for t in terms)

    def scan(self, scan: Scan, nothing: bool, few: bool) -> None:
        if nothing:
            types = [f"c{i} {'timestamp_ntz' if c.iso else _SPARK[c.affinity]}" for i, c in enumerate(self.schema.columns) if not c.refused]
            self.df, self.ordered = self.spark.createDataFrame([], ", ".join(types)), False
        else:
            self.df = self.table.frame(self.spark, scan.pushed, few)
            self.ordered = ROW_ID in self.df.columns
        self.in_order = self.ordered and self.table.in_order
        self.raw = True  # nothing since the scan has gathered its rows
        self.row = cells(self.schema, dict(self.df.dtypes))

    def filter(self, f: Filter) -> None:
        vals = [self.compiler.condition(t) for t in f.terms]
        if all(v.raised is None for v in vals):
            for v in vals:
                self.df = self.df.where(v.col)
            return
        raised, reached = F.lit(False), F.lit(True)
        for v in vals:  # a term runs where all before it are TRUE
            if v.raised is not None:
                raised = raised | (reached & v.raised)
            reached = reached & F.coalesce(v.col, F.lit(False))
        self.df = self.df.where(raise_if(raised, tree([v.col for v in vals], lambda a, b: a & b)))

    def values(self, nodes: list[Node]) -> list[Val]:
        """Values of expressions, after a check that none of them raises."""
        vals = [self.compiler.value(n) for n in nodes]
        raised = [v.raised for v in vals if v.raised is not None]
        if raised:
            self.df = self.df.where(raise_if(tree(raised, lambda a, b: a | b), F.lit(True)))
        return [number(replace(v, raised=None)) if v.kind is Kind.BOOL else replace(v, raised=None) for v in vals]

    def rename(self, vals: list[Val], *more: Column) -> None:
        """Makes the values the frame's columns, with the row id if there is one."""
        keep = [F.col(ROW_ID)] if self.ordered else []
        self.df = self.df.select(*[v.col.alias(f"v{i}") for i, v in enumerate(vals)], *keep, *more)
        self.row = [replace(v, col=F.col(f"v{i}"), const=False, stamp=None) for i, v in enumerate(vals)]

    def aggregate(self, a: Aggregate) -> None:
        args = [None if not c.args or isinstance(c.args[0], Star) else c.args[0] for c in a.calls]
        vals = self.values([*a.keys, *[n for n in args if n is not None]])
        self.rename(vals)
        self.in_order = self.raw = False
        keys, rest = self.row[: len(a.keys)], iter(self.row[len(a.keys) :])
        outs = [compute(fold(c.name), None if n is None else next(rest), c.distinct, self.ordered) for c, n in zip(a.calls, args, strict=True)]
        found = [v.col.alias(f"a{i}") for i, v in enumerate(outs)]
        if a.keys:
            by = [sort_key(v).alias(f"k{i}") for i, v in enumerate(keys)]
            if self.ordered:  # show the value that was seen first
                shown = [F.min_by(v.col, F.col(ROW_ID)).alias(f"v{i}") for i, v in enumerate(keys)]
                self.df = self.df.groupBy(*by).agg(*shown, F.min(ROW_ID).alias(ROW_ID), *found)
            else:
                shown = [F.any_value(v.col).alias(f"v{i}") for i, v in enumerate(keys) if v.kind is Kind.NUM]
                grouped = self.df.groupBy(*by)
                found = [*found, *shown]
                self.df = grouped.agg(*found) if found else grouped.agg(F.count(F.lit(1)).alias("unused"))
                for i, v in enumerate(keys):
                    if v.kind is not Kind.NUM:
                        self.df = self.df.withColumnRenamed(f"k{i}", f"v{i}")
        else:
            self.df, self.ordered = self.df.agg(*found) if found else self.df.agg(F.count(F.lit(1)).alias("unused")), False
        self.row = [replace(v, col=F.col(f"v{i}")) for i, v in enumerate(keys)] + [replace(v, col=F.col(f"a{i}")) for i, v in enumerate(outs)]
        self.schema = aggregate_schema(a, self.schema)

    def sort(self, s: Sort) -> None:
        self.keys = s.keys

    def project(self, p: Project) -> None:
        keys = getattr(self, "keys", ())
        vals = self.values([*[o.expr for o in p.items], *[k.expr for k in keys]])
        self.rename(vals)
        self.row, sorting = self.row[: len(p.items)], self.row[len(p.items) :]
        self.sorting = list(zip(sorting, keys, strict=True))

    def distinct(self) -> None:
        """Rows that differ; where rows have an order, the first of each and in that order."""
        self.in_order = self.raw = False
        by = [key(v).alias(f"k{i}") if v.kind is Kind.NUM else v.col.alias(f"k{i}") for i, v in enumerate(self.row)]
        every = [c for c in self.df.columns if c != ROW_ID]
        if self.ordered:
            one = [F.min_by(c, F.col(ROW_ID)).alias(c) for c in every]
            self.df = self.df.groupBy(*by).agg(*one, F.min(ROW_ID).alias(ROW_ID))
        elif any(v.kind is Kind.NUM for v in self.row):
            self.df = self.df.groupBy(*by).agg(*[F.any_value(c).alias(c) for c in every])
        else:
            # sort keys are made of the row's own values
            self.df = self.df.dropDuplicates([f"v{i}" for i in range(len(self.row))])

    def finish(self, limit: Limit | None, mixed: str) -> DataFrame:
        order = [F.desc_nulls_last(sort_key(v)) if k.descending else F.asc_nulls_first(sort_key(v)) for v, k in self.sorting]
        df = self.df
        if self.ordered and not (self.in_order and not order):
            order.append(F.asc(ROW_ID))
        if order and self.raw and self.ordered and self.table.dear:
            # ranges are sampled from what is sorted; an exchange below holds the rows, so that the scan runs once
            df = df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), ROW_ID)
        df = df.orderBy(*order) if order else df
        if limit is not None:
            df = df.offset(limit.offset) if limit.offset else df
            df = df.limit(limit.limit) if limit.limit >= 0 and limit.limit < 1 << 31 else df
        out = []
        for v, name in zip(self.row, self.names, strict=True):
            col = v.col if v.kind is not Kind.NUM else double(v) if mixed == "double" else F.when(v.known, num_struct(v.i, v.r))
            out.append(col.alias(name))
        return df.select(*out)

