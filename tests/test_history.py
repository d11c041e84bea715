"""Commits, their files and hunks, refs and the tree, against git's own commands asked commit by commit."""

import os
import subprocess

import pytest

from tessera.cli import main
from tessera.engine import Engine
from tessera.sources.history import repository, unquoted
from tests.test_blame import ANA, ZOE, commit


def git(repo, *args, text=True):
    return subprocess.run(["git", "-C", repo, "-c", "core.quotePath=false", *args], capture_output=True, check=True, text=text).stdout


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("history"))
    subprocess.run(["git", "init", "-q", "-b", "main", path], check=True)
    body = "".join(f"line {i}\n" for i in range(60))
    commit(path, 1700000000, ANA, {"src/a.py": body, "b\t\"q\".txt": "one\n", "bin.dat": b"\x00\x01"})
    commit(path, 1700003600, ZOE, {"src/a.py": body.replace("line 3\n", "LINE 3\n+++ odd\n").replace("line 50\n", ""), "é.txt": "é\n-- x\n", "bin.dat": b"\x00\x02"})
    os.rename(f"{path}/src/a.py", f"{path}/src/renamed.py")
    commit(path, 1700007200, ANA, {"no_end": "x"}, remove=["b\t\"q\".txt"])
    git(path, "checkout", "-qb", "side", "HEAD~1")
    commit(path, 1700008000, ZOE, {"side.txt": "s\n"})
    git(path, "checkout", "-q", "main")
    env = {**os.environ, "GIT_AUTHOR_DATE": "1700009000 +0000", "GIT_COMMITTER_DATE": "1700009000 +0000"}
    subprocess.run(["git", "-C", path, "-c", "user.name=Ana Petrova", "-c", "user.email=ana@example.com", "merge", "-q", "--no-ff", "-m", "merge it\n\nwith a body", "side"], check=True, env=env)
    subprocess.run(["git", "-C", path, "-c", "user.name=x", "-c", "user.email=x@example.com", "tag", "-a", "v1", "-m", "t", "HEAD~1"], check=True, env=env)
    return path


@pytest.fixture
def engine(spark, repo):
    return Engine(spark, repository(repo))


def test_commits(engine, repo):
    rows = engine.rows("SELECT hash, author_name, author_email, committer_name, subject, message, parent_count, authored_at FROM commits")
    hashes = git(repo, "rev-list", "HEAD").split()
    assert [r[0] for r in rows] == hashes and len(hashes) == 5
    for own, name, mail, committer, subject, message, parents, when in rows:
        show = lambda f, own=own: git(repo, "show", "-s", f"--format={f}", own).rstrip("\n")
        assert (name, mail, committer, subject, message) == (show("%an"), show("%ae"), show("%cn"), show("%s"), show("%B"))
        assert parents == len(show("%P").split()) and when.startswith("2023-11-1") and when.endswith("Z")


def test_commit_files(engine, repo):
    rows = engine.rows("SELECT hash, path, old_path, status, additions, deletions FROM commit_files")
    want = []
    for own in git(repo, "rev-list", "--no-merges", "HEAD").split():
        names = [x.split("\t") for x in git(repo, "show", "-M", "--format=", "--name-status", "-z", own).replace("\0", "\t").rstrip("\t").split("\n")][0]
        while names:
            status, names = names[0][0], names[1:]
            old, names = (names[0], names[1:]) if status == "R" else (None, names)
            if names[0].startswith("b") and len(names) > 1 and names[1].startswith('"'):
                names = ["\t".join(names[:2]), *names[2:]]
            want.append((own, names[0], old, status))
            names = names[1:]
    assert sorted(r[:4] for r in rows) == sorted(want, key=lambda r: (r[0], r[1]))
    by = {(r[1], r[3]): r[4:] for r in rows}
    assert by["src/a.py", "A"] == (60, 0) and by["src/a.py", "M"] == (2, 2) and by["src/renamed.py", "R"] == (0, 0) and by["bin.dat", "M"] == (None, None)


def test_diffs(engine, repo):
    rows = engine.rows("SELECT path, hunk_no, old_start, new_start, added_text, removed_text FROM diffs JOIN commits USING (hash) WHERE author_name = 'Zoë Müller' AND path <> 'side.txt'")
    assert sorted(rows) == [("src/a.py", 1, 1, 1, "LINE 3\n+++ odd", "line 3"), ("src/a.py", 2, 48, 49, "", "line 50"), ("é.txt", 1, 0, 1, "é\n-- x", "")]
    # every added and removed line of the history, counted by git
    counts = {r[0]: r[1:] for r in engine.rows("SELECT hash, sum(additions), sum(deletions) FROM commit_files GROUP BY hash")}
    lines = {}
    for own, added, removed in engine.rows("SELECT hash, added_text, removed_text FROM diffs"):
        a, b = lines.get(own, (0, 0))
        lines[own] = a + (added.count("\n") + 1 if added else 0), b + (removed.count("\n") + 1 if removed else 0)
    assert lines == counts
    assert engine.rows('SELECT path FROM diffs WHERE path LIKE \'b%\' AND added_text = \'one\'') == [('b\t"q".txt',)]


def test_refs_and_tree(engine, repo):
    head, side, tag = (git(repo, "rev-parse", x).strip() for x in ("HEAD", "side", "v1^{commit}"))
    assert engine.rows("SELECT name, kind, target_hash, is_head FROM refs") == [("main", "branch", head, 1), ("side", "branch", side, 0), ("v1", "tag", tag, 0)]
    rows = engine.rows("SELECT path, mode, blob_hash, size FROM tree")
    assert [r[0] for r in rows] == git(repo, "ls-tree", "-rz", "--name-only", "HEAD").split("\0")[:-1]
    for path, mode, own, size in rows:
        assert mode == "100644" and git(repo, "rev-parse", f"HEAD:{path}").strip() == own and int(git(repo, "cat-file", "-s", own)) == size
    assert engine.rows("SELECT path FROM tree WHERE path LIKE 'SRC/%'") == [("src/renamed.py",)]


@pytest.mark.parametrize(
    ("where", "commits"),
    [
        ("author_name = 'Ana Petrova'", 3),
        ("author_email IN ('zoe@example.com', 'x')", 2),
        ("authored_at >= '2023-11-14T23:13:20Z' AND '2023-11-15T00:13:20Z' >= authored_at", 2),
        ("authored_at < '2023-11-14T23'", 1),
        ("hash = 'no such'", 0),
        ("subject = 'change'", 5),
        ("author_name LIKE 'ana%'", 5),
    ],
)
def test_terms_choose_commits(engine, where, commits):
    text = f"SELECT hash, subject FROM commits WHERE {where}"
    q = engine.query(text)
    assert f"{commits} of 5 commits" in q.explain()
    assert q.rows() == engine.query(text, pushdown=False).rows()


def test_few_rows_take_few_processes(spark, tmp_path):
    path = str(tmp_path)
    subprocess.run(["git", "init", "-q", path], check=True)
    tree = git(path, "write-tree").strip()
    run = ["git", "-C", path, "-c", "user.name=n", "-c", "user.email=e", "commit-tree", tree, "-m", "m"]
    parent = []
    for i in range(200):
        env = {**os.environ, "GIT_AUTHOR_DATE": f"{1700000000 + i} +0000", "GIT_COMMITTER_DATE": f"{1700000000 + i} +0000"}
        parent = ["-p", subprocess.run([*run, *parent], capture_output=True, check=True, text=True, env=env).stdout.strip()]
    git(path, "update-ref", "HEAD", parent[1])
    tables = repository(path)
    engine = Engine(spark, tables)
    assert engine.rows("SELECT authored_at FROM commits LIMIT 2") == [("2023-11-14T22:16:39Z",), ("2023-11-14T22:16:38Z",)]
    assert tables["commits"].git_invocations == 2
    assert engine.rows("SELECT count(*) FROM commits") == [(200,)]
    assert engine.rows("SELECT authored_at FROM commits ORDER BY authored_at LIMIT 1") == [("2023-11-14T22:13:20Z",)]


def test_joined_on_the_command_line(spark, repo, capsys):
    text = "SELECT a.path, b.path FROM commit_files AS a JOIN commit_files AS b ON a.hash = b.hash AND a.path < b.path WHERE a.status = 'M'"
    assert main(["-C", repo, "-f", "csv", text], spark) == 0
    assert capsys.readouterr().out == "path,path\nbin.dat,src/a.py\nbin.dat,é.txt\nsrc/a.py,é.txt\n"
    assert main(["-C", repo, "--stats", "SELECT count(*) FROM refs"], spark) == 0
    assert capsys.readouterr().err.splitlines()[:2] == ["0 paths blamed, 0 skipped", "1 git invocation"]


def test_terms_of_joined_tables_reach_their_scans(engine, repo):
    tables = engine.tables
    q = engine.query("SELECT subject, path FROM commits JOIN commit_files USING (hash) WHERE author_name = 'Ana Petrova' AND path LIKE 'src/%'")
    assert q.explain().splitlines()[-1].strip() == "commits JOIN commit_files (pushed: author_name = 'Ana Petrova')"
    assert sorted(q.rows()) == [("change", "src/a.py"), ("change", "src/renamed.py")]
    assert tables["commits"].git_invocations <= 1 + 3


def test_quoted_paths():
    assert [unquoted(x) for x in ('"a\\tb"', '"\\303\\251\\"\\\\"', "plain é", "blank \t")] == ["a\tb", 'é"\\', "plain é", "blank "]
