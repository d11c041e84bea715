"""Inner equi-joins: several tables as one.

Each table gives its own frame, narrowed by the terms that it accepts; equal
columns join them, in the order of FROM. Spark chooses how: it broadcasts a side
that it measures as small, and else shuffles both by the key and splits skewed
ones. Columns of different kinds meet by their comparison keys, so 1 = 1.0 joins
too. NULL joins nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.native import cells, equal
from tessera.plans.binder import Source, columns_in
from tessera.plans.syntax import Field, Node, rewritten
from tessera.sources.base import ROW_ID, Estimate, Table
from tessera.types import Schema


class JoinedTable(Table):
    """Rows have an order if those of every table have: by the first table's, then the next one's."""

    def __init__(self, schema: Schema, sources: Sequence[Source], tables: Sequence[Table]) -> None:
        self.schema, self.sources, self.tables = schema, list(sources), list(tables)
        self.dear = any(t.dear for t in tables)

    def home(self, term: Node) -> tuple[int, Node] | None:
        """The one table whose columns a term reads, and the term over its own row."""
        used = columns_in(term)
        for k, s in enumerate(self.sources):
            if used and all(s.first <= i < s.first + len(s.schema.columns) for i in used):
                own = lambda n, first=s.first: Field(n.at, n.index - first, n.name) if isinstance(n, Field) else None
                return k, rewritten(term, own)
        return None

    def accepts(self, term: Node) -> bool:
        at = self.home(term)
        return at is not None and self.tables[at[0]].accepts(at[1])

    def frame(self, spark: SparkSession, pushed: Sequence[Node], few: bool = False) -> DataFrame:
        own: list[list[Node]] = [[] for _ in self.tables]
        for term in pushed:
            k, moved = self.home(term)
            own[k].append(moved)
        out, row, ids = None, [], []
        for k, (s, table) in enumerate(zip(self.sources, self.tables, strict=True)):
            df = table.frame(spark, own[k])
            ids.append(ROW_ID in df.columns)
            kept = [F.col(f"c{i}").alias(f"c{s.first + i}") for i, c in enumerate(s.schema.columns) if not c.refused]
            df = df.select(*kept, *([F.col(ROW_ID).alias(f"r{k}")] if ids[-1] else []))
            row += cells(s.schema, dict(df.dtypes), s.first)
            if out is None:
                out = df
                continue
            affinity = lambda f: self.schema.columns[f.index].affinity
            out = out.join(df, reduce(lambda a, b: a & b, [equal(row[a.index], row[b.index], affinity(a), affinity(b)) for a, b in s.on]))
        columns = [F.col(f"c{i}") for i, c in enumerate(self.schema.columns) if not c.refused]
        return out.select(*columns, *([F.struct(*[f"r{k}" for k in range(len(ids))]).alias(ROW_ID)] if all(ids) else []))

    def estimate(self, pushed: Sequence[Node]) -> Estimate | None:
        return None
