"""What the author of a query is told when something is wrong with it.

There is one type for all of it. ``sort`` says which part of the engine objects,
``at`` where in the text, and ``hints`` what could have been meant instead.
"""

from __future__ import annotations

from collections.abc import Iterable
from enum import Enum
from typing import NamedTuple


class Position(NamedTuple):
    """Counted from 1, in code points."""

    line: int
    column: int

    def __str__(self) -> str:
        return f"line {self.line}, column {self.column}"


class Sort(Enum):
    TOKEN = "a text that is no token"
    GRAMMAR = "tokens in a wrong place"
    OMITTED = "SQL that the dialect has no part of"
    NAME = "a name, an ordinal or a call that stands for nothing here"
    VALUE = "a value that an operation has no result for"


class QueryError(Exception):
    def __init__(self, sort: Sort, text: str, at: Position | None = None, hints: Iterable[str] = ()) -> None:
        super().__init__(text)
        self.sort, self.at, self.hints = sort, at, tuple(hints)

    def report(self) -> str:
        """The message, and below it the place and the hints."""
        more = [f"  at {self.at}"] if self.at else []
        if self.hints:
            more.append(f"  known here: {', '.join(self.hints)}")
        return "\n".join([str(self), *more])


class SourceError(Exception):
    """The data of a table is out of reach or damaged."""
