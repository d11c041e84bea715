"""Schemas of the dialect: ordered columns, each with one of three affinities or none."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1


class Affinity(Enum):
    TEXT = "TEXT"
    INTEGER = "INTEGER"
    REAL = "REAL"


@dataclass(frozen=True)
class Column:
    """``low`` and ``high`` bound an INTEGER column's values; ``iso`` marks text made of a timestamp column; ``refused`` names a type without values in the dialect."""

    name: str
    affinity: Affinity | None
    low: int = INT_MIN
    high: int = INT_MAX
    iso: bool = False
    refused: str | None = None


@dataclass(frozen=True)
class Schema:
    columns: tuple[Column, ...]

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns)

    def index_of(self, name: str) -> int:
        for i, c in enumerate(self.columns):
            if same_name(c.name, name):
                return i
        raise KeyError(name)


_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def fold(name: str) -> str:
    """ASCII letters in lower case; others as they are."""
    return name.translate(_FOLD)


def same_name(a: str, b: str) -> bool:
    return fold(a) == fold(b)
