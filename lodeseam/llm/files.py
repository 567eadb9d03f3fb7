"""Current files put together again from the line windows they are stored as."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_key

#: Suffix of a path to the language it is parsed as.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "json": "json", "toml": "toml"}


def suffix(path: str = "path"):
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def current_files(chunks: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """(repo_id, path, text): the newest version (greatest indexed_at) of every file, whole.

    A window gives the lines after those that earlier windows gave; repeated rows and symbol chunks give none. Rows with
    null repo_id, path, content or indexed_at are left out; a null start_line counts as 1; a line that no chunk holds is
    missing from the text. One shuffle, by file: no repository, however large, is gathered.
    """
    rows = chunks.filter(F.col("repo_id").isNotNull() & F.col("path").isNotNull() & F.col("content").isNotNull() & F.col("indexed_at").isNotNull())
    if suffixes:
        rows = rows.filter(suffix().isin(suffixes))
    rows = rows.select("repo_id", "path", "indexed_at", F.coalesce("start_line", F.lit(1)).alias("start_line"), "content")
    rows = by_key(rows, "repo_id", "path")
    of_file = Window.partitionBy("repo_id", "path")
    rows = rows.withColumn("newest", F.max("indexed_at").over(of_file)).filter(F.col("indexed_at") == F.col("newest"))
    rows = rows.withColumn("n", F.length("content") - F.length(F.replace("content", F.lit("\n"))) + 1)
    order = of_file.orderBy("start_line", F.desc("n"))
    seen = F.coalesce(F.max(F.col("start_line") + F.col("n") - 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("seen", seen).filter(F.col("start_line") + F.col("n") - 1 > F.col("seen"))
    skip = F.greatest(F.lit(0), F.col("seen") - F.col("start_line") + 1)
    tail = F.when(skip == 0, F.col("content")).otherwise(F.array_join(F.slice(F.split("content", "\n"), skip + 1, F.col("n")), "\n"))
    pieces = rows.select("repo_id", "path", F.struct("start_line", tail.alias("text")).alias("piece"))
    return pieces.groupBy("repo_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["text"]), "\n").alias("text"))
