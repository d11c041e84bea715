"""The other tables of a git repository: commits, commit_files, diffs, refs and tree.

Of the history, one cheap process on the driver lists the commits reachable from
HEAD, newest first, with author and time. Terms over these choose commits exactly:
``hash`` and the author's columns by = and IN, ``authored_at`` by the comparisons.
The chosen ones are dealt in order to tasks, and a task asks git once for all of
its commits' messages, files or hunks. Where the first rows may do, a partition is
a few commits, so Spark stops after those that give enough. Executors must reach
the repository at the same place.

Merges have no files and hunks, as in git's own log; renames are found. ``refs``
and ``tree`` are read by one process each.
"""

from __future__ import annotations

import math
import operator
import re
import subprocess
from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.errors import SourceError
from tessera.plans.syntax import Binary, Field, In, Lit, Node
from tessera.sources import blame
from tessera.sources.base import ROW_ID, Estimate, Table
from tessera.types import Affinity, Column, Schema

TEXT, INTEGER = Affinity.TEXT, Affinity.INTEGER
MOST = (1 << 31) - 1


def schema(**columns: Affinity) -> Schema:
    return Schema(tuple(Column(n, a, 0, MOST) if a is INTEGER else Column(n, a) for n, a in columns.items()))


def moment(seconds: str) -> str:
    return datetime.fromtimestamp(int(seconds), UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def asked(repo: str, program: str, args: Sequence[str], hashes: Sequence[str]) -> bytes:
    """What git says of the commits that it reads from its input."""
    try:
        done = subprocess.run([program, "-C", repo, "-c", "core.quotePath=false", *args], input="".join(f"{h}\n" for h in hashes).encode(), capture_output=True, check=False)
    except OSError as e:
        raise SourceError(str(e)) from e
    if done.returncode:
        raise SourceError(f"git {' '.join(args)} failed: {done.stderr.decode('utf-8', 'replace')}")
    return done.stdout


# -- what a task reads of its commits: arguments for git, and rows (hash first) of its answer


def messages(raw: bytes) -> Iterator[tuple]:
    for entry in raw.decode("utf-8", "replace").split("\0")[:-1]:
        own, author, a_mail, a_time, committer, c_mail, c_time, parents, subject, message = entry.split("\n", 9)
        yield own, author, a_mail, moment(a_time), committer, c_mail, moment(c_time), subject, message.rstrip("\n"), len(parents.split())


def files(raw: bytes) -> Iterator[tuple]:
    """Per commit: its hash, entries that begin with a colon (status last, then the paths), and counts with the same paths."""
    tokens = iter(raw.decode("utf-8", "replace").split("\0")[:-1])
    own, changed, counts = "", [], []

    def rows() -> Iterator[tuple]:
        for (old, path, status), (more, less) in zip(changed, counts, strict=True):
            number = lambda x: None if x == "-" else int(x)
            yield own, path, old, "M" if status == "T" else status, number(more), number(less)

    for t in tokens:
        if t.startswith(":"):
            status = t.rpartition(" ")[2][0]
            old = next(tokens) if status in "RC" else None
            changed.append((old, next(tokens), "A" if status == "C" else status))
        elif "\t" in t:
            more, less, path = t.split("\t", 2)
            if not path:
                next(tokens), next(tokens)
            counts.append((more, less))
        else:
            yield from rows()
            own, changed, counts = t, [], []
    yield from rows()


HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "\\": 92}


def unquoted(name: str) -> str:
    """A path as git prints it in headers; unusual ones in quotes, with C's escapes."""
    if not name.startswith('"'):
        return name.removesuffix("\t")
    one = lambda m: bytes([int(m[1], 8) if m[1].isdigit() else _ESCAPES[m[1]]]).decode("latin-1")
    return re.sub(r"\\([0-7]{3}|.)", one, name[1:-1].encode().decode("latin-1")).encode("latin-1").decode("utf-8", "replace")


def hunks(raw: bytes) -> Iterator[tuple]:
    own = path = ""
    lines = iter(raw.decode("utf-8", "replace").split("\n"))
    number = 0
    for line in lines:
        if line.startswith("diff --git "):
            number = 0
        elif line.startswith("--- ") and line != "--- /dev/null" or line.startswith("+++ ") and line != "+++ /dev/null":
            path = unquoted(line[4:])
        elif m := HUNK.match(line):
            number += 1
            left, right = (1 if x is None else int(x) for x in (m[2], m[4]))
            added, removed = [], []
            while left or right:
                line = next(lines)
                left -= line[:1] in (" ", "-", "")
                right -= line[:1] in (" ", "+", "")
                (added if line[:1] == "+" else removed if line[:1] == "-" else []).append(line[1:])
            yield own, path, number, int(m[1]), int(m[3]), "\n".join(added), "\n".join(removed)
        elif re.fullmatch("[0-9a-f]{40,64}", line):
            own = line


_LOG = ["log", "--no-walk=unsorted", "--stdin", "-z", "--format=tformat:%H%n%an%n%ae%n%at%n%cn%n%ce%n%ct%n%P%n%s%n%B"]
_FILES = ["diff-tree", "--stdin", "-r", "-M", "--root", "--raw", "--numstat", "-z"]
_HUNKS = ["diff-tree", "--stdin", "-r", "-M", "--root", "-p", "--no-prefix"]

#: Columns that the driver's listing has, by name, and how terms compare them.
_LISTED = ("hash", "authored_at", "author_name", "author_email")
_TESTS = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_TURNED = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


class HistoryTable(Table):
    """Rows of the commits reachable from HEAD, newest first."""

    in_order = True
    dear = True
    blamed_paths: frozenset[str] = frozenset()
    tracked = 0

    def __init__(self, repo: str, schema: Schema, args: list[str], rows: Callable[[bytes], Iterator[tuple]], commits_at_a_time: int) -> None:
        self.repo, self.schema, self.args, self.rows, self.batch = repo, schema, args, rows, commits_at_a_time
        self.listings, self._runs = 0, None

    @property
    def git_invocations(self) -> int:
        return self.listings + (self._runs.value if self._runs is not None else 0)

    def tests(self, term: Node) -> tuple[str, Callable[[str], bool]] | None:
        """A listed column, and the test that a term makes of it."""
        named = lambda n: self.schema.columns[n.index].name if isinstance(n, Field) and self.schema.columns[n.index].name in _LISTED else None
        text = lambda n: isinstance(n, Lit) and isinstance(n.value, str)
        match term:
            case Binary(op=op) if op in _TESTS:
                for column, other, sign in ((term.a, term.b, op), (term.b, term.a, _TURNED[op])):
                    if (name := named(column)) and text(other) and (sign == "=" or name == "authored_at"):
                        return name, lambda x: _TESTS[sign](x.encode(), other.value.encode())
            case In(negated=False) if (name := named(term.x)) and all(map(text, term.items)):
                return name, {n.value for n in term.items}.__contains__
        return None

    def accepts(self, term: Node) -> bool:
        return self.tests(term) is not None

    def chosen(self, pushed: Sequence[Node]) -> tuple[list[str], int]:
        listed = blame.git(self.repo, "log", "-z", "--format=tformat:%H%n%at%n%an%n%ae", "HEAD").decode("utf-8", "replace").split("\0")[:-1]
        out = []
        for entry in listed:
            own, when, *author = entry.split("\n")
            known = dict(zip(_LISTED, (own, moment(when), *author), strict=True))
            if all(test(known[name]) for name, test in map(self.tests, pushed)):
                out.append(own)
        return out, len(listed)

    def frame(self, spark: SparkSession, pushed: Sequence[Node], few: bool = False) -> DataFrame:
        hashes, _ = self.chosen(pushed)
        self.listings, self._runs = 1, spark.sparkContext.accumulator(0)
        repo, args, rows, runs, program = self.repo, self.args, self.rows, self._runs, blame.GIT
        kinds = ["bigint" if c.affinity is INTEGER else "string" for c in self.schema.columns]
        types = ", ".join([*(f"c{i} {k}" for i, k in enumerate(kinds)), f"{ROW_ID} struct<commit:bigint,row:bigint>"])
        arrow = [pa.int64() if k == "bigint" else pa.string() for k in kinds]

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = dict(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True))
                if not place:
                    continue
                runs.add(1)
                found = list(rows(asked(repo, program, args, list(place))))
                columns = list(zip(*found, strict=True)) or [()] * len(kinds)
                rid = pa.StructArray.from_arrays([pa.array([place[h] for h in columns[0]], pa.int64()), pa.array(range(len(found)), pa.int64())], ["commit", "row"])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, arrow, strict=True)), rid], names=[*(f"c{i}" for i in range(len(kinds))), ROW_ID])

        if not hashes:
            return spark.createDataFrame([], types)
        size = min(64, self.batch) if few else max(1, min(self.batch, math.ceil(len(hashes) / (2 * spark.sparkContext.defaultParallelism))))
        listed = spark.createDataFrame(list(enumerate(hashes)), "i bigint, hash string")
        out = listed.repartitionByRange(math.ceil(len(hashes) / size), "i").sortWithinPartitions("i").mapInArrow(read, types)
        return out.sortWithinPartitions(ROW_ID) if few else out

    def estimate(self, pushed: Sequence[Node]) -> Estimate:
        hashes, every = self.chosen(pushed)
        return Estimate("HistoryScan", len(hashes), every, "commits")


class ListedTable(Table):
    """Rows that one process gives to the driver."""

    blamed_paths: frozenset[str] = frozenset()
    tracked = 0

    def __init__(self, repo: str, schema: Schema, rows: Callable[[str], list[tuple]], by_path: bool = False) -> None:
        self.repo, self.schema, self.rows, self.by_path = repo, schema, rows, by_path
        self.git_invocations = 0

    def accepts(self, term: Node) -> bool:
        return self.by_path and blame.accepts_path(term)

    def kept(self, pushed: Sequence[Node]) -> tuple[list[tuple], int]:
        every = self.rows(self.repo)
        if not self.by_path:
            return every, len(every)
        by_path = {r[0]: r for r in every}
        return [by_path[p] for p in blame.narrowed(list(by_path), pushed)], len(every)

    def frame(self, spark: SparkSession, pushed: Sequence[Node], few: bool = False) -> DataFrame:
        self.git_invocations = 1
        rows, _ = self.kept(pushed)
        types = ", ".join([*(f"c{i} {'bigint' if c.affinity is INTEGER else 'string'}" for i, c in enumerate(self.schema.columns)), f"{ROW_ID} bigint"])
        return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], types)

    def estimate(self, pushed: Sequence[Node]) -> Estimate:
        rows, every = self.kept(pushed)
        return Estimate("ListScan", len(rows), every, "rows")


def refs(repo: str) -> list[tuple]:
    """name, kind, target_hash (of an annotated tag, what it names) and is_head, by full name."""
    out = []
    raw = blame.git(repo, "for-each-ref", "--format=%(refname)%00%(objectname)%00%(*objectname)%00%(HEAD)", "refs/heads", "refs/tags", "refs/remotes")
    for line in raw.decode("utf-8", "replace").splitlines():
        name, own, peeled, head = line.split("\0")
        _, kind, short = name.split("/", 2)
        out.append((short, {"heads": "branch", "tags": "tag", "remotes": "remote"}[kind], peeled or own, int(head == "*")))
    return out


def tree(repo: str) -> list[tuple]:
    """path, mode, blob_hash and size (NULL for a submodule) of each file at HEAD, in git's order."""
    out = []
    for entry in blame.git(repo, "ls-tree", "-r", "-l", "-z", "HEAD").decode("utf-8", "replace").split("\0")[:-1]:
        about, path = entry.split("\t", 1)
        mode, _, own, size = about.split()
        out.append((path, mode, own, None if size == "-" else int(size)))
    return out


COMMITS = schema(hash=TEXT, author_name=TEXT, author_email=TEXT, authored_at=TEXT, committer_name=TEXT, committer_email=TEXT, committed_at=TEXT, subject=TEXT, message=TEXT, parent_count=INTEGER)
COMMIT_FILES = schema(hash=TEXT, path=TEXT, old_path=TEXT, status=TEXT, additions=INTEGER, deletions=INTEGER)
DIFFS = schema(hash=TEXT, path=TEXT, hunk_no=INTEGER, old_start=INTEGER, new_start=INTEGER, added_text=TEXT, removed_text=TEXT)
REFS = schema(name=TEXT, kind=TEXT, target_hash=TEXT, is_head=INTEGER)
TREE = schema(path=TEXT, mode=TEXT, blob_hash=TEXT, size=INTEGER)


def repository(repo: str) -> dict[str, Table]:
    """All tables of a repository, by name."""
    return {
        "blame": blame.BlameTable(repo),
        "commits": HistoryTable(repo, COMMITS, _LOG, messages, 2000),
        "commit_files": HistoryTable(repo, COMMIT_FILES, _FILES, files, 500),
        "diffs": HistoryTable(repo, DIFFS, _HUNKS, hunks, 100),
        "refs": ListedTable(repo, REFS, refs),
        "tree": ListedTable(repo, TREE, tree, by_path=True),
    }
