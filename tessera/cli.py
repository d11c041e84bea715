"""``python -m tessera``: one query over a git repository: the lines alive at HEAD, files, refs and history."""

from __future__ import annotations

import csv
import io
import json
import os
import sys
import time
from argparse import ArgumentParser
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from tessera.engine import Engine, Query
from tessera.errors import QueryError, SourceError
from tessera.functions.values import Value
from tessera.sources.base import Table
from tessera.sources.history import repository

Rows = Sequence[tuple[Value, ...]]


def aligned(names: Sequence[str], rows: Rows) -> str:
    """Columns as wide as their widest cell, two blanks between, none at the end of a line."""
    cells = [list(names), *[["NULL" if v is None else str(v) for v in r] for r in rows]]
    widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
    return "".join("  ".join(c.ljust(w) for c, w in zip(line, widths, strict=True)).rstrip() + "\n" for line in cells)


def separated(mark: str) -> Callable[[Sequence[str], Rows], str]:
    """Fields between marks, quoted where they must be; NULL is an empty one."""

    def text(names: Sequence[str], rows: Rows) -> str:
        out = io.StringIO()
        csv.writer(out, delimiter=mark, lineterminator="\n").writerows([names, *[["" if v is None else v for v in r] for r in rows]])
        return out.getvalue()

    return text


def objects(names: Sequence[str], rows: Rows) -> str:
    return json.dumps([dict(zip(names, r, strict=True)) for r in rows], ensure_ascii=False) + "\n"


FORMATS = {"table": aligned, "csv": separated(","), "tsv": separated("\t"), "json": objects}

#: Flags with what argparse needs to know of them.
OPTIONS: dict[tuple[str, ...], dict] = {
    ("query",): {"help": "a SELECT statement"},
    ("-C", "--repo"): {"default": ".", "help": "folder of the git repository; without it, the one you are in"},
    ("--explain",): {"action": "store_true", "help": "show how the query would run, without running it"},
    ("--stats",): {"action": "store_true", "help": "tell on stderr how many files git was asked about, and how long that took"},
    ("--no-pushdown",): {"action": "store_true", "help": "ask git about every file, whatever the WHERE clause says"},
    ("-f", "--format"): {"choices": sorted(FORMATS), "default": "table", "help": "shape of the output"},
}


def session() -> SparkSession:
    quiet = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8"}
    spark = SparkSession.builder.master("local[*]").appName("tessera").config(map=quiet).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def work(table: Table, seconds: float) -> str:
    """Three fixed lines: paths, processes, time."""
    every = getattr(table, "tables", [table])
    read, tracked, runs = sum(len(t.blamed_paths) for t in every), sum(t.tracked for t in every), sum(t.git_invocations for t in every)
    paths = "path" if read == 1 else "paths"
    git = "git invocation" if runs == 1 else "git invocations"
    return f"{read} {paths} blamed, {tracked - read} skipped\n{runs} {git}\n{seconds:.2f}s\n"


def told(trouble: Exception, repo: str) -> tuple[int, str]:
    """The exit code of a failure, and what to say of it."""
    if isinstance(trouble, QueryError):
        return 1, trouble.report()
    if isinstance(trouble, SourceError | OSError):
        return 3, f"no git repository that can be read at {repo}"
    return 4, f"the engine failed ({type(trouble).__name__}), which is its fault and not the query's"


def output(query: Query, explain: bool, shape: str) -> str:
    return query.explain() if explain else FORMATS[shape](query.names, query.rows())


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit codes: 0 done, or nobody reads on; 1 a wrong query; 2 wrong usage; 3 no readable repository; 4 a fault of the engine."""
    parser = ArgumentParser(prog="tessera", description=__doc__)
    for names, settings in OPTIONS.items():
        parser.add_argument(*names, **settings)
    asked = parser.parse_args(argv)
    began = time.monotonic()
    try:
        query = Engine(spark or session(), repository(os.path.abspath(asked.repo))).query(asked.query, pushdown=not asked.no_pushdown)
        text = output(query, asked.explain, asked.format)  # whole before any of it is shown
        sys.stdout.write(text)
        sys.stdout.flush()
        if asked.stats and not asked.explain:
            sys.stderr.write(work(query.table, time.monotonic() - began))
    except BrokenPipeError:
        pass
    except Exception as trouble:  # noqa: BLE001  never a traceback
        code, line = told(trouble, asked.repo)
        sys.stderr.write(f"error: {line}\n")
        return code
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
