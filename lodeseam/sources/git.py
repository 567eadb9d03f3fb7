"""Committed files of git repositories as a Spark data source, and the probes around it.

spark.dataSource.register(GitTreeSource)
spark.read.format("git_tree").option("repos", "/a\\n/b").load() reads every repository in partitions of its own.
"""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import threading
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LARGEST = 1_000_000
#: Directories that discovery doesn't enter.
PRUNED = {".git", "node_modules", ".venv", "venv", "__pycache__", ".cache", "vendor", "dist", "build", "target", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache"}


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], check=True, capture_output=True).stdout


def head(repo: str) -> str:
    return git(repo, "rev-parse", "HEAD").decode().strip()


def dirty(repo: str) -> bool:
    return bool(git(repo, "status", "--porcelain", "--untracked-files=no").strip())


def root(path: str) -> str:
    """The root of the repository that a path lies in; it is the repository's id as well."""
    return os.path.realpath(git(os.path.expanduser(path), "rev-parse", "--show-toplevel").decode().strip())


def remote(repo: str) -> str:
    found = subprocess.run(["git", "-C", repo, "config", "--get", "remote.origin.url"], capture_output=True).stdout
    return found.decode(errors="replace").strip()


def tracked_files(repo: str) -> list[str]:
    return sorted(p.decode("utf-8", "surrogateescape") for p in git(repo, "ls-files", "-z").split(b"\0") if p)


def ignore_text(repo: str, commit: str, name: str = ".lodeseamignore") -> str:
    """The ignore file of a commit, '' if it has none."""
    found = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, "show", f"{commit}:{name}"], capture_output=True)
    return found.stdout.decode("utf-8", "replace") if found.returncode == 0 else ""


def changes(repo: str, old: str, new: str) -> tuple[set[str], set[str]]:
    """(changed, removed) paths between two commits."""
    return parse_changes(git(repo, "diff", "--name-status", "-z", old, new))


def is_linked_worktree(folder: Path) -> bool:
    marker = folder / ".git"
    if not marker.is_file():
        return False
    first = marker.read_text(errors="replace").split("\n", 1)[0]
    return first.startswith("gitdir:") and "/worktrees/" in first


def discover(root: str, worktrees: bool = False) -> tuple[list[str], int]:
    """(repositories under root in order, linked worktrees left out)."""
    found, skipped = [], 0
    for folder, dirs, files in os.walk(root):
        if ".git" in dirs or ".git" in files:
            dirs[:] = []
            if not worktrees and is_linked_worktree(Path(folder)):
                skipped += 1
            else:
                found.append(folder)
        else:
            dirs[:] = sorted(d for d in dirs if d not in PRUNED)
    return sorted(found), skipped


def parse_tree(raw: bytes) -> Iterator[tuple[str, str, int]]:
    """(path, object, size) of the blobs of `ls-tree -r -z -l`; entries without a size are left out."""
    for entry in raw.split(b"\0"):
        meta, _, path = entry.partition(b"\t")
        fields = meta.split()
        if len(fields) == 4 and fields[1] == b"blob" and fields[3].isdigit():
            yield path.decode("utf-8", "surrogateescape"), fields[2].decode(), int(fields[3])


def parse_changes(raw: bytes) -> tuple[set[str], set[str]]:
    """(changed, removed) paths of `diff --name-status -z`; a rename removes its old path and changes its new one."""
    changed: set[str] = set()
    removed: set[str] = set()
    parts = iter(raw.decode("utf-8", "surrogateescape").split("\0"))
    for status in parts:
        if not status:
            continue
        path = next(parts)
        if status[0] in "RC":
            if status[0] == "R":
                removed.add(path)
            changed.add(next(parts))
        elif status[0] == "D":
            removed.add(path)
        else:
            changed.add(path)
    return changed, removed


def readable(data: bytes) -> str | None:
    """The text of a file that is neither large nor binary nor of another encoding."""
    if len(data) > LARGEST or b"\0" in data[:4096]:
        return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def blobs(repo: str, names: list[str]) -> Iterator[bytes]:
    """The contents of objects, in order, by one process; the names are written while contents are read."""
    with subprocess.Popen(["git", "-c", "safe.directory=*", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as process:
        writer = threading.Thread(target=lambda: (process.stdin.write("".join(f"{n}\n" for n in names).encode()), process.stdin.close()))
        writer.start()
        for _ in names:
            size = int(process.stdout.readline().split()[2])
            yield process.stdout.read(size)
            process.stdout.read(1)
        writer.join()


#: Bytes of files that one partition reads, about.
PARTITION_BYTES = 64 << 20


class RepoPartition(InputPartition):
    """A share of a repository's files at one commit: (path, object, size), object '' for what isn't read."""

    def __init__(self, repo: str, commit: str, files: list[tuple[str, str, int]]) -> None:
        self.repo, self.commit, self.files = repo, commit, files


class GitTreeReader(DataSourceReader):
    """The head of every repository is taken once, when partitions are planned; large trees make several partitions."""

    def __init__(self, repos: list[str], since: dict[str, str], commits: dict[str, str]) -> None:
        self.repos, self.since, self.commits = repos, since, commits

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for repo in self.repos:
            commit = self.commits.get(repo) or head(repo)
            wanted = changes(repo, self.since[repo], commit)[0] if repo in self.since else None
            part, size = [], 0
            for path, blob, n in parse_tree(git(repo, "ls-tree", "-r", "-z", "-l", commit)):
                if wanted is not None and path not in wanted:
                    continue
                part.append((path, blob if n <= LARGEST else "", n))
                size += min(n, LARGEST)
                if size >= PARTITION_BYTES:
                    out.append(RepoPartition(repo, commit, part))
                    part, size = [], 0
            if part:
                out.append(RepoPartition(repo, commit, part))
        return out or [RepoPartition("", "", [])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        contents = blobs(partition.repo, [b for _, b, _ in partition.files if b]) if partition.files else iter(())
        for path, blob, size in partition.files:
            text = readable(next(contents)) if blob else None
            digest = hashlib.sha256(text.encode()).hexdigest() if text is not None else None
            yield partition.repo, partition.repo, path.encode("utf-8", "replace").decode(), partition.commit, size, digest, text


class GitTreeSource(DataSource):
    """Columns: repo_id, repo_path, path, commit_sha, size_bytes, content_hash, content (null for what isn't text).

    Options: repos, one a line; since and commits, JSON objects by repository: the commit whose differences alone are
    read, and the commit to read instead of the head.
    """

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "repo_id string, repo_path string, path string, commit_sha string, size_bytes long, content_hash string, content string"

    def reader(self, schema) -> GitTreeReader:
        repos = [r for r in self.options.get("repos", "").split("\n") if r]
        return GitTreeReader(repos, json.loads(self.options.get("since") or "{}"), json.loads(self.options.get("commits") or "{}"))
