"""Small tables of given rows, in their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.plans.syntax import Node
from tessera.sources.base import ROW_ID, Estimate, Table
from tessera.types import Affinity, Schema

_TYPES = {Affinity.TEXT: T.StringType(), Affinity.INTEGER: T.LongType(), Affinity.REAL: T.DoubleType()}


class MemoryTable(Table):
    def __init__(self, schema: Schema, rows: Sequence[tuple]) -> None:
        self.schema, self.rows, self.scans = schema, list(rows), 0

    def frame(self, spark: SparkSession, pushed: Sequence[Node], few: bool = False) -> DataFrame:
        self.scans += 1
        fields = [T.StructField(f"c{i}", _TYPES[c.affinity]) for i, c in enumerate(self.schema.columns)]
        fields.append(T.StructField(ROW_ID, T.LongType()))
        real = [c.affinity is Affinity.REAL for c in self.schema.columns]
        rows = [(*[float(v) if is_real and v is not None else v for v, is_real in zip(r, real, strict=True)], i) for i, r in enumerate(self.rows)]
        return spark.createDataFrame(rows, T.StructType(fields))

    def estimate(self, pushed: Sequence[Node]) -> Estimate:
        return Estimate("MemoryScan", len(self.rows), len(self.rows), "rows")
