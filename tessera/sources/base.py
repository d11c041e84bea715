"""What the engine asks of a table."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.syntax import Node
from tessera.types import Schema

#: A hidden column by which rows have an order; a table without one gives rows in any.
ROW_ID = "_rid"


@dataclass(frozen=True)
class Estimate:
    """A scan's name, and how many of its units it would read."""

    name: str
    selected: int
    total: int
    unit: str = "paths"


class Table(ABC):
    """A relation. Columns of the frame are named c0, c1, ... in schema order; ROW_ID may follow."""

    schema: Schema
    #: Whether frames hold their rows in order, partition by partition.
    in_order = False
    #: Whether reading a row is so dear that the scan mustn't run twice.
    dear = False

    def accepts(self, term: Node) -> bool:
        """Whether the scan can narrow itself by a term, judged by its shape alone."""
        return False

    @abstractmethod
    def frame(self, spark: SparkSession, pushed: Sequence[Node], few: bool = False) -> DataFrame:
        """At least the rows that the pushed terms keep. ``few``: the query may need only the first of them."""

    @abstractmethod
    def estimate(self, pushed: Sequence[Node]) -> Estimate | None:
        """What frame() would read, without reading it."""
