"""Hooks of git repositories that bring the index up to date after a commit or merge."""

from __future__ import annotations

import os
import shlex
import stat
from pathlib import Path

from . import git

NAMES = ("post-commit", "post-merge")
MARK = "lodeseam reindex"


def _place(repo: str, name: str) -> Path:
    path = Path(git.git(repo, "rev-parse", "--git-path", f"hooks/{name}").decode().strip())
    return path if path.is_absolute() else Path(repo) / path


def install(repo: str, db: str, command: str = "lodeseam") -> list[str]:
    """Write the hooks; one of another make that is there already is left alone. The names written."""
    written = []
    for name in NAMES:
        path = _place(repo, name)
        if path.exists() and MARK not in path.read_text(errors="replace"):
            continue
        path.parent.mkdir(parents=True, exist_ok=True)
        call = f"{command} --db {shlex.quote(db)} reindex \"$PWD\""
        path.write_text(f"#!/bin/sh\n# {MARK}: keeps the index fresh; a failure never hinders git.\nif command -v {command} >/dev/null 2>&1; then\n  {call} >/dev/null 2>&1 || true\nfi\n")
        path.chmod(path.stat().st_mode | stat.S_IXUSR)
        written.append(name)
    return written


def inspect(repo: str) -> dict:
    """Which hooks are there, missing, of another make or not executable, and whether all is as it should be."""
    out: dict = {"present": [], "missing": [], "foreign": [], "non_executable": []}
    for name in NAMES:
        path = _place(repo, name)
        if not path.exists():
            out["missing"].append(name)
            continue
        out["present"].append(name)
        if MARK not in path.read_text(errors="replace"):
            out["foreign"].append(name)
        if not os.access(path, os.X_OK):
            out["non_executable"].append(name)
    return {"repo_path": repo, "installed": not (out["missing"] or out["foreign"] or out["non_executable"]), **out}


def summary(found: list[dict]) -> dict:
    """Repositories checked, with hooks and without, and what those lack."""
    lacking = [f for f in found if not f.get("installed")]
    return {"repos_checked": len(found), "installed": len(found) - len(lacking), "missing": len(lacking), "missing_repos": lacking}
