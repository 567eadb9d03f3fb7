"""Index maintenance as table operations: snapshot differences, upserts, replacement, removal, pruning, coverage, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change): added, removed, changed or same, by a null-safe comparison of `value`."""
    a = old.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """table with rows inserted or, on equal keys, put in place of the old; columns in `keep` keep their old value."""
    keep = keep or []
    columns = table.columns
    old = table.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in columns if c not in keys], F.lit(True).alias("_in_old"))
    new = rows.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns if c not in keys], F.lit(True).alias("_in_new"))
    joined = old.join(new, keys, "full_outer")

    def value(c: str) -> Column:
        if c in keep:
            return F.when(F.col("_in_old"), F.col(f"_old_{c}")).otherwise(F.col(f"_new_{c}")).alias(c)
        return F.when(F.col("_in_new"), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c)

    return joined.select(*[F.col(c) if c in keys else value(c) for c in columns])


def replace_files(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the files that `new` holds replaced by its."""
    return chunks.join(new.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti").unionByName(new.select(*chunks.columns))


def replace_repos(chunks: DataFrame, new: DataFrame, repos: DataFrame) -> DataFrame:
    """All rows of the given repositories (repo_id) replaced by `new`; one without new rows ends up empty."""
    return chunks.join(repos.select("repo_id").distinct(), "repo_id", "left_anti").unionByName(new.select(*chunks.columns))


def outcome(repos: DataFrame, runs: DataFrame) -> DataFrame:
    """repos after runs (repo_id, repo_path, remote_url, commit_sha, error, at): a success takes the commit and clears the
    errors, a failure keeps the commit and its time and counts one error more."""
    new = runs.select("repo_id", *[F.col(c).alias(f"_{c}") for c in ("repo_path", "remote_url", "commit_sha", "error", "at")], F.lit(True).alias("_ran"))
    both = repos.join(new, "repo_id", "full_outer")
    ran, good = F.coalesce("_ran", F.lit(False)), F.col("_error").isNull()
    return both.select(
        "repo_id",
        F.when(ran, F.col("_repo_path")).otherwise(F.col("repo_path")).alias("repo_path"),
        F.coalesce("_remote_url", "remote_url").alias("remote_url"),
        F.when(ran & good, F.coalesce("_commit_sha", F.lit(""))).otherwise(F.coalesce("last_commit_sha", F.lit(""))).alias("last_commit_sha"),
        F.when(ran & good, F.col("_at")).otherwise(F.col("indexed_at")).alias("indexed_at"),
        F.when(ran, F.col("_error")).otherwise(F.col("last_error")).alias("last_error"),
        F.when(ran & good, 0).otherwise(F.coalesce("error_count", F.lit(0)) + ran.cast("int")).alias("error_count"),
    )


def delete_paths(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    return chunks.join(paths.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti")


def remove_repos(table: DataFrame, repos: DataFrame, names: DataFrame) -> DataFrame:
    """table without the repositories whose id or path is among names(name)."""
    wanted = names.select("name").distinct()
    ids = repos.join(wanted, F.col("repo_id") == F.col("name"), "left_semi").select("repo_id").unionByName(repos.join(wanted, F.col("repo_path") == F.col("name"), "left_semi").select("repo_id")).distinct()
    return table.join(ids, "repo_id", "left_anti")


def aliases(repos: DataFrame, current: DataFrame) -> DataFrame:
    """Old ids of a path that now goes by another id: (repo_id) to be deleted everywhere."""
    now = current.select(F.col("repo_id").alias("new_id"), "repo_path")
    return repos.join(now, "repo_path").filter("repo_id <> new_id").select("repo_id").distinct()


def orphans(table: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows whose repository isn't in repos."""
    return table.join(repos.select("repo_id").distinct(), "repo_id", "left_anti")


def coverage(chunks: DataFrame, dims: int) -> DataFrame:
    """Per model: chunks, those with a usable vector of `dims` numbers, and whether all have one."""
    usable = F.coalesce(F.size("embedding") == dims, F.lit(False))
    counts = chunks.groupBy("embedding_model").agg(F.count("*").alias("chunks"), F.count_if(usable).alias("vectors"))
    return counts.withColumn("complete", F.col("chunks") == F.col("vectors"))


def repo_status(repos: DataFrame, chunks: DataFrame, heads: DataFrame) -> DataFrame:
    """repos with chunk_count (0 if none) and staleness: a head other than the last indexed commit, errors, or no head.
    heads: (repo_id, head[, dirty]); a repository that wasn't probed is stale and not dirty."""
    counts = chunks.groupBy("repo_id").agg(F.count("*").alias("chunk_count"))
    rows = repos.join(counts, "repo_id", "left").join(heads, "repo_id", "left")
    stale = F.col("head").isNull() | (F.col("head") != F.col("last_commit_sha")) | (F.coalesce("error_count", F.lit(0)) > 0)
    dirty = {"has_dirty_tracked_files": F.coalesce("dirty", F.lit(False))} if "dirty" in heads.columns else {}
    return rows.withColumns({"chunk_count": F.coalesce("chunk_count", F.lit(0)), "is_stale": stale, **dirty}).drop("dirty")


def with_state(results: DataFrame, status: DataFrame) -> DataFrame:
    """Results with their repository's state; of an unknown repository they are stale and not dirty."""
    known = {"is_stale": True, "has_dirty_tracked_files": False}
    have = [c for c in known if c in status.columns]
    rows = results.join(status.select("repo_id", *have), "repo_id", "left")
    return rows.withColumns({c: F.coalesce(F.col(c) if c in have else F.lit(None).cast("boolean"), F.lit(v)) for c, v in known.items()})


def migrated(old: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """old with the columns of `defaults` that it lacks."""
    return old.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in old.columns})
