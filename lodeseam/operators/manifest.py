"""Numbered manifests: what holds in a folder of tables is switched as a whole, by the exclusive creation of one file."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..session import _delete, _hadoop, create_file, read_file


class Manifest:
    """commit-N.json says what holds from commit N on. N + 1 can be created once: of two runs that began at N one wins,
    and the other's files count for nothing. Readers see one commit or the next, never half of one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def commits(self) -> list[int]:
        files, path = _hadoop(self.spark, self.folder)
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return sorted(int(n[7:-5]) for n in names if n.startswith("commit-") and n.endswith(".json"))

    def current(self) -> dict:
        """The last commit; {"number": 0} before the first."""
        known = self.commits()
        return json.loads(read_file(self.spark, f"{self.folder}/commit-{known[-1]}.json") or b"{}") if known else {"number": 0}

    def commit(self, before: dict, after: dict) -> int:
        """Make `after` hold, if nothing was committed since `before` was read."""
        number = before["number"] + 1
        if not create_file(self.spark, f"{self.folder}/commit-{number}.json", json.dumps({**after, "number": number}).encode()):
            raise RuntimeError(f"another run has committed {number}")
        return number

    def delete(self, paths: list[str]) -> None:
        for path in paths:
            _delete(self.spark, path)
