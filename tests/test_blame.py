"""Line authorship over real repositories, the work it avoids, and the command line."""

import json
import os
import subprocess

import pytest

from tessera.cli import main
from tessera.engine import Engine
from tessera.errors import SourceError
from tessera.sources.blame import BlameTable


def commit(repo, when, author, files, remove=()):
    for name, content in files.items():
        path = os.path.join(repo, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content.encode() if isinstance(content, str) else content)
    for name in remove:
        os.remove(os.path.join(repo, name))
    stamp = f"{when} +0000"
    env = {**os.environ, "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null", "GIT_AUTHOR_DATE": stamp, "GIT_COMMITTER_DATE": stamp}
    name, mail = author
    run = ["git", "-C", repo, "-c", f"user.name={name}", "-c", f"user.email={mail}"]
    subprocess.run([*run, "add", "-A"], check=True, env=env)
    subprocess.run([*run, "commit", "-qm", "change"], check=True, env=env)


ANA, ZOE = ("Ana Petrova", "ana@example.com"), ("Zoë Müller", "zoe@example.com")


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("repo"))
    subprocess.run(["git", "init", "-q", path], check=True)
    commit(path, 1700000000, ANA, {"src/utils.py": "def util():\n    return 42\n", "feature/thing.py": "print('feature')\n", "empty.txt": "", "SRC/b.py": "b\n"})
    commit(path, 1700003600, ZOE, {"src/utils.py": "def util():\n    return 43\n\nauthor Somebody\n", "café.py": "é = 1\r\n\tx\n", "no_newline.txt": "a\nb", "bin.dat": b"\x00\xff\xfe\n"})
    return path


@pytest.fixture
def blame(spark, repo):
    table = BlameTable(repo)
    return Engine(spark, {"blame": table}), table


def expected(repo):
    """The same rows by another route: git's plain porcelain with every header of its own commit."""
    paths = subprocess.run(["git", "-C", repo, "ls-tree", "-r", "-z", "--name-only", "HEAD"], capture_output=True, check=True).stdout.decode().split("\0")[:-1]
    rows = []
    for p in paths:
        out = subprocess.run(["git", "-C", repo, "blame", "-p", "HEAD", "--", p], capture_output=True, check=True).stdout.decode("utf-8", "replace")
        known, current, number = {}, None, 0
        for line in out.split("\n")[:-1]:
            head = line.split(" ")
            if line.startswith("\t"):
                number += 1
                rows.append((p, number, line[1:], current, known[current]["author"], known[current]["author-mail"][1:-1]))
            elif len(head[0]) == 40 and all(c in "0123456789abcdef" for c in head[0]):
                current = head[0]
                known.setdefault(current, {})
            else:
                known[current][head[0]] = line.partition(" ")[2]
    return rows


def test_rows_are_gits(blame, repo):
    engine, table = blame
    assert engine.rows("SELECT path, line_no, line, commit_hash, author_name, author_email FROM blame") == expected(repo)
    assert {r[0] for r in engine.rows("SELECT DISTINCT authored_at FROM blame")} == {"2023-11-14T22:13:20Z", "2023-11-14T23:13:20Z"}
    assert table.tracked == 7


@pytest.mark.parametrize(
    ("where", "paths"),
    [
        ("path = 'src/utils.py'", {"src/utils.py"}),
        ("'src/utils.py' = path AND line_no > 1", {"src/utils.py"}),
        ("path LIKE 'src/%'", {"src/utils.py", "SRC/b.py"}),
        ("path IN ('no_newline.txt', 'gone', 'src/utils.py')", {"no_newline.txt", "src/utils.py"}),
        ("path LIKE 'src/%' AND path = 'SRC/b.py'", {"SRC/b.py"}),
        ("path IN ()", set()),
        ("path = 'gone'", set()),
        ("1 = 2", set()),
        ("path LIKE '%.py'", None),
        ("path LIKE 'src/_%'", None),
        ("path NOT IN ('src/utils.py')", None),
        ("path = 'src/utils.py' OR line_no = 1", None),
    ],
)
def test_work_avoided_and_rows_unchanged(blame, where, paths):
    engine, table = blame
    text = f"SELECT path, line_no, line FROM blame WHERE {where}"
    full = engine.query(text, pushdown=False).rows()
    assert sorted(engine.rows(text)) == sorted(full)
    read = table.blamed_paths
    if paths is None:
        assert len(read) == 7
    elif where != "1 = 2":
        assert read == paths and table.git_invocations == 1 + len(paths)


@pytest.fixture
def processes(monkeypatch, tmp_path):
    """Puts a git that notes each call before the real one; gives the calls so far that blame."""
    import shutil

    log, own = tmp_path / "calls", tmp_path / "bin"
    own.mkdir()
    log.touch()
    (own / "git").write_text(f'#!/bin/sh\necho "$*" >> {log}\nexec {shutil.which("git")} "$@"\n')
    (own / "git").chmod(0o755)
    monkeypatch.setattr("tessera.sources.blame.GIT", str(own / "git"))
    return lambda: sum(" blame " in x for x in log.read_text().splitlines())


@pytest.mark.parametrize(
    ("text", "most"),
    [
        ("SELECT path, line_no FROM blame", 7),
        ("SELECT path, line FROM blame ORDER BY line DESC", 7),
        ("SELECT author_name, count(*) FROM blame GROUP BY author_name ORDER BY 2", 7),
        ("SELECT DISTINCT author_name FROM blame ORDER BY 1", 7),
        ("SELECT path, line FROM blame WHERE path LIKE 'src/%' ORDER BY line LIMIT 1", 2),
        ("SELECT path FROM blame LIMIT 1", 1),
        ("SELECT path FROM blame LIMIT 2 OFFSET 1", 5),
        ("SELECT path FROM blame WHERE line_no = 1 LIMIT 1", 1),
        ("SELECT path FROM blame LIMIT 0", 0),
    ],
)
def test_processes(blame, processes, text, most):
    """One git process for each path at most, as few as give the first rows, and as many as the table says."""
    engine, table = blame
    engine.rows(text)
    assert processes() <= most
    if most != 5:
        assert processes() == most
    if most:
        assert table.git_invocations == 1 + processes()


def test_limits_take_the_first_rows(blame):
    engine, _ = blame
    every = engine.rows("SELECT path, line_no FROM blame")
    for n, m in ((1, 0), (3, 2), (100, 0), (2, 100)):
        assert engine.rows(f"SELECT path, line_no FROM blame LIMIT {n} OFFSET {m}") == every[m : m + n]


def test_list_order(blame):
    engine, _ = blame
    found = engine.rows("SELECT path FROM blame WHERE path IN ('src/utils.py', 'café.py')")
    assert [p for p, in dict.fromkeys(found)] == ["src/utils.py", "café.py"]


def test_explain_runs_no_blame(blame):
    engine, table = blame
    q = engine.query("SELECT author_name, count(*) FROM blame WHERE path LIKE 'src/%' GROUP BY author_name")
    assert q.explain().splitlines()[-1].strip() == "BlameScan (pushed: path LIKE 'src/%' -> 2 of 7 paths)"
    assert table.blamed_paths == set()


def test_unreadable(spark, tmp_path):
    with pytest.raises(SourceError):
        Engine(spark, {"blame": BlameTable(str(tmp_path))}).rows("SELECT 1 FROM blame")


def test_command_line(spark, repo, capsys, tmp_path):
    assert main(["-C", repo, "--stats", "SELECT path, count(*) FROM blame WHERE path = 'src/utils.py' GROUP BY path"], spark) == 0
    out = capsys.readouterr()
    assert out.out == "path          column_2\nsrc/utils.py  4\n"
    assert out.err.splitlines()[:2] == ["1 path blamed, 6 skipped", "2 git invocations"]
    assert main(["-C", repo, "SELECT path, NULL AS n, 1.0 FROM blame WHERE 0"], spark) == 0
    assert capsys.readouterr().out == "path  n  column_3\n"
    assert main(["-C", repo, "SELECT ghost FROM blame"], spark) == 1
    assert capsys.readouterr().err.splitlines()[:2] == ["error: no such column: ghost", "  at line 1, column 8"]
    assert main(["-C", str(tmp_path), "SELECT 1 FROM blame"], spark) == 3
    capsys.readouterr()
    assert main(["-C", repo, "--explain", "SELECT 1 FROM blame"], spark) == 0
    assert capsys.readouterr().out == "Project (1)\n  BlameScan (pushed: none -> 7 of 7 paths)\n"
    with pytest.raises(SystemExit) as e:
        main(["--nonsense"])
    assert e.value.code == 2
    capsys.readouterr()
    assert main(["-C", repo, "-f", "json", "SELECT line_no, NULL AS n FROM blame WHERE path = 'SRC/b.py'"], spark) == 0
    assert json.loads(capsys.readouterr().out) == [{"line_no": 1, "n": None}]
    assert main(["-C", repo, "-f", "csv", "SELECT line, NULL AS n FROM blame WHERE path = 'SRC/b.py'"], spark) == 0
    assert capsys.readouterr().out == "line,n\nb,\n"
