import subprocess

import pytest
from pyspark.sql import functions as F

from lodeseam.sources import files, git
from lodeseam.sources.jsonl import append_events, golden_cases


def run(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t.example", *args], check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "root" / "one"
    root.mkdir(parents=True)
    run(root, "init", "-q", "-b", "main")
    (root / "a.py").write_text("x = 1\n")
    (root / "é b.md").write_text("text\n")
    (root / "bin.dat").write_bytes(b"a\0b")
    run(root, "add", ".")
    run(root, "commit", "-qm", "first")
    return root


def test_git_source(spark, repo):
    spark.dataSource.register(git.GitTreeSource)
    rows = {r.path: r for r in spark.read.format("git_tree").option("repos", str(repo)).load().collect()}
    assert set(rows) == {"a.py", "é b.md", "bin.dat"} and rows["a.py"].content == "x = 1\n" and rows["bin.dat"].content is None
    assert rows["a.py"].commit_sha == git.head(str(repo)) and not git.dirty(str(repo))
    (repo / "a.py").write_text("y")
    assert git.dirty(str(repo))


def test_changes_and_discovery(repo, tmp_path):
    first = git.head(str(repo))
    run(repo, "mv", "a.py", "c.py")
    (repo / "new.py").write_text("n = 1\n")
    (repo / "bin.dat").unlink()
    run(repo, "add", "-A")
    run(repo, "commit", "-qm", "second")
    changed, removed = git.parse_changes(git.git(str(repo), "diff", "--name-status", "-z", first, "HEAD"))
    assert changed == {"c.py", "new.py"} and removed == {"a.py", "bin.dat"}
    linked = tmp_path / "root" / "linked"
    run(repo, "worktree", "add", "-q", str(linked), "-b", "w")
    (tmp_path / "root" / "node_modules" / "x" / ".git").mkdir(parents=True)
    assert git.discover(str(tmp_path / "root")) == ([str(repo)], 1)
    assert git.discover(str(tmp_path / "root"), worktrees=True) == ([str(linked), str(repo)], 0)


def test_only_changes_are_read(spark, repo, tmp_path):
    import json

    first = git.head(str(repo))
    (repo / "a.py").write_text("x = 2\n")
    (repo / "new.py").write_text("n = 1\n")
    run(repo, "add", "-A")
    run(repo, "commit", "-qm", "second")
    spark.dataSource.register(git.GitTreeSource)
    read = lambda **o: {r.path: r.content for r in spark.read.format("git_tree").options(repos=str(repo), **o).load().collect()}
    assert read(since=json.dumps({str(repo): first})) == {"a.py": "x = 2\n", "new.py": "n = 1\n"}
    assert read(commits=json.dumps({str(repo): first}))["a.py"] == "x = 1\n"
    assert git.tracked_files(str(repo)) == ["a.py", "bin.dat", "new.py", "é b.md"] and git.root(str(repo / ".")) == str(repo) and git.remote(str(repo)) == ""
    assert git.changes(str(repo), first, "HEAD") == ({"a.py", "new.py"}, set()) and git.ignore_text(str(repo), "HEAD") == ""


def test_partitions_of_a_large_tree(repo, monkeypatch):
    monkeypatch.setattr(git, "PARTITION_BYTES", 5)
    reader = git.GitTreeReader([str(repo)], {}, {})
    parts = reader.partitions()
    assert len(parts) >= 2 and len({p.commit for p in parts}) == 1
    assert sorted(row[2] for p in parts for row in reader.read(p)) == ["a.py", "bin.dat", "é b.md"]
    assert [list(reader.read(p)) for p in git.GitTreeReader([], {}, {}).partitions()] == [[]]


def test_readable():
    assert git.readable(b"a\0") is None and git.readable(b"\xff") is None and git.readable(b"x" * 1_000_001) is None and git.readable("é".encode()) == "é"


def test_text_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("é\n", encoding="utf-8")
    (tmp_path / "bin").write_bytes(b"a\0b")
    (tmp_path / "latin").write_bytes(b"\xe9")
    (tmp_path / "big").write_text("x" * 50)
    got = {r.path.rsplit("/", 1)[-1]: r.content for r in files.text_files(spark, str(tmp_path), largest=40).collect()}
    assert got == {"a.txt": "é\n"}


def test_jsonl(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('# note\n\n{"id": "1", "query": "q", "expected_path": "p"}\n')
    assert [r.id for r in golden_cases(spark, str(tmp_path / "g.jsonl")).collect()] == ["1"]
    (tmp_path / "b.jsonl").write_text('# note\n\n{"id": "1", "query": "q", "expected_path": "p"}\nbroken\n')
    with pytest.raises(ValueError, match="line 4: no object"):
        golden_cases(spark, str(tmp_path / "b.jsonl"))
    append_events(spark.range(2).select(F.lit("search").alias("event")), str(tmp_path / "log"))
    append_events(spark.range(1).select(F.lit("miss").alias("event")), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3
