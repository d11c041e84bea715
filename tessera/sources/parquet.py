"""Parquet tables. Catalyst narrows these scans itself, so no term is negotiated.

Integer columns become INTEGER, as do decimals without a fraction of at most 18
digits, and booleans (0 and 1); floating ones and other decimals REAL, strings
TEXT; timestamps and dates TEXT in ISO 8601 of one width, in UTC whatever the
session's time zone. A query that names a column of another type is refused.
Bounds of narrow integer types are kept, so their arithmetic needs no overflow
checks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.syntax import Node
from tessera.sources.base import ROW_ID, Estimate, Table
from tessera.types import Affinity, Column, Schema

_WIDTH = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def column(f: T.StructField) -> Column:
    kind = type(f.dataType)
    if kind is T.BooleanType:
        return Column(f.name, Affinity.INTEGER, 0, 1)
    if kind is T.DecimalType:
        most = 10**f.dataType.precision - 1
        return Column(f.name, Affinity.INTEGER, -most, most) if f.dataType.scale == 0 and f.dataType.precision <= 18 else Column(f.name, Affinity.REAL)
    if kind in _WIDTH:
        half = 1 << (_WIDTH[kind] - 1)
        return Column(f.name, Affinity.INTEGER, -half, half - 1)
    if kind in (T.FloatType, T.DoubleType):
        return Column(f.name, Affinity.REAL)
    if kind is T.StringType:
        return Column(f.name, Affinity.TEXT)
    if kind in (T.TimestampType, T.TimestampNTZType, T.DateType):
        return Column(f.name, Affinity.TEXT, iso=True)
    return Column(f.name, None, refused=f.dataType.simpleString().upper())


class ParquetTable(Table):
    """``ordered`` gives rows the order of files and of rows within them, which ties and first-seen values then follow."""

    def __init__(self, spark: SparkSession, path: str, ordered: bool = False) -> None:
        self.path, self.ordered = path, ordered
        self.fields = [(f, column(f)) for f in spark.read.parquet(path).schema.fields]
        self.schema = Schema(tuple(c for _, c in self.fields))

    def frame(self, spark: SparkSession, pushed: Sequence[Node], few: bool = False) -> DataFrame:
        df = spark.read.parquet(self.path)
        cols = []
        for i, (f, c) in enumerate(self.fields):
            if c.refused:
                continue
            raw = F.col(f"`{f.name}`")
            kind = {Affinity.INTEGER: "bigint", Affinity.REAL: "double", Affinity.TEXT: "string"}[c.affinity]
            # dates and timestamps without zone stay as written; only instants have a zone to be told in
            own = raw.cast("timestamp_ntz") if isinstance(f.dataType, T.DateType) else raw
            cols.append((own if c.iso else raw.cast(kind)).alias(f"c{i}"))
        if self.ordered:
            cols.append(F.struct("_metadata.file_path", "_metadata.row_index").alias(ROW_ID))
        return df.select(*cols)

    def estimate(self, pushed: Sequence[Node]) -> Estimate | None:
        return None

