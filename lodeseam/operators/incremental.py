"""Processing only new or changed records: processed sequence numbers kept as disjoint intervals.

Every record has a key and, within it, a sequence number, its own or one that the ledger gives it when it is first seen
and keeps. What was processed is a table of disjoint intervals per key; what is to be done is the available ranges minus
those, gaps of late records included. A run processes the gaps, writes its output, the numbers it gave and the merged
intervals into a folder of its own, and commits all at once by one manifest. A run that fails leaves nothing that counts,
and the next one finds the same gaps.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, tracked
from .manifest import Manifest

#: Sequences of one repository: its files are spread over them by their path, so that no window sees them all.
BLOCKS = 64


def intervals(numbers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi): the disjoint, non-adjacent intervals that hold exactly the given numbers (keys, seq)."""
    return merge(numbers.select(*keys, F.col("seq").alias("lo"), F.col("seq").alias("hi")), keys)


def merge(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping and adjacent intervals made one; repeated, null and reversed ones don't matter."""
    clean = ranges.filter(F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("lo") <= F.col("hi"))).select(*keys, "lo", "hi").distinct()
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = clean.withColumn("begins", F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0))
    grouped = marked.withColumn("island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def subtract(available: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi): what of the available intervals no processed interval covers. Null keys are keys like others."""
    ends = merge(available, keys).select(*keys, "lo", "hi", F.lit(1).alias("gain"), F.lit(0).alias("cover"))
    done = merge(processed, keys).select(*keys, "lo", "hi", F.lit(0).alias("gain"), F.lit(1).alias("cover"))
    both = ends.unionByName(done)
    # a sweep over the points where an interval begins or has just ended
    points = both.select(*keys, F.col("lo").alias("at"), "gain", "cover").unionByName(both.select(*keys, (F.col("hi") + 1).alias("at"), (-F.col("gain")).alias("gain"), (-F.col("cover")).alias("cover")))
    steps = points.groupBy(*keys, "at").agg(F.sum("gain").alias("gain"), F.sum("cover").alias("cover"))
    order = Window.partitionBy(*keys).orderBy("at")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = steps.withColumns({"open": F.sum("gain").over(running), "shut": F.sum("cover").over(running), "next": F.lead("at").over(order)})
    pieces = swept.filter((F.col("open") > 0) & (F.col("shut") == 0)).select(*keys, F.col("at").alias("lo"), (F.col("next") - 1).alias("hi"))
    return merge(pieces, keys)


def join_null_safe(a: DataFrame, b: DataFrame, columns: list[str], how: str) -> DataFrame:
    """a joined with b where the columns are equal or both null; the columns of b but those are added."""
    other = b.select([F.col(c).alias(f"_of_{c}" if c in columns else c) for c in b.columns])
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return a.join(other, on, how).drop(*[f"_of_{c}" for c in columns])


def expand(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq): every number of the intervals."""
    return ranges.select(*keys, F.explode(F.sequence("lo", "hi")).alias("seq"))


def plain_hash(value: Column | str) -> Column:
    """A content hash without the ways it is written: case, blanks, a leading "sha256:"; null where nothing is left."""
    value = F.col(value) if isinstance(value, str) else value
    text = F.regexp_replace(F.trim(F.lower(value)), r"^sha256:\s*", "")
    return F.when(text == "", None).otherwise(text)


def heads(tree_files: DataFrame) -> DataFrame:
    """(repo_id, head): the commit of each repository with the greatest committed_at."""
    known = tree_files.filter("repo_id is not null and commit_sha is not null and committed_at is not null")
    return known.groupBy("repo_id").agg(F.max(F.struct("committed_at", "commit_sha"))["commit_sha"].alias("head"))


def head_files(tree_files: DataFrame) -> DataFrame:
    """(repo_id, path, hash): the files of each head; repeated rows once, of contradicting ones the last arrived."""
    rows = tree_files.join(heads(tree_files), "repo_id").filter((F.col("commit_sha") == F.col("head")) & F.col("path").isNotNull())
    return rows.groupBy("repo_id", "path").agg(F.max(F.struct("arrived_at", plain_hash("content_hash").alias("hash")))["hash"].alias("hash"))


def indexed_state(indexed_files: DataFrame) -> DataFrame:
    """(repo_id, path, indexed_hash): the hash of each file's newest row, null where that row has none."""
    rows = indexed_files.filter("repo_id is not null and path is not null")
    newest = F.max(F.struct("indexed_at", plain_hash("content_hash").alias("hash")))["hash"]
    return rows.groupBy("repo_id", "path").agg(newest.alias("indexed_hash"))


def file_records(files: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(repo_id, block, path, hash) of file versions (repo_id, path, hash)."""
    return files.select("repo_id", F.pmod(F.xxhash64("path"), F.lit(blocks)).cast("int").alias("block"), "path", "hash")


def pending_files(tree_files: DataFrame, indexed_files: DataFrame, blocks: int = BLOCKS, ledger: Ledger | None = None) -> DataFrame:
    """(repo_id, path) of the head files still to be processed: those whose hash isn't that of their newest index row.

    The index's newest rows are what earlier runs have processed: the ledger (a new one in the shared folder if none is
    given) numbers and commits them first. Then the head's files are its records: those it knows keep their numbers,
    others, however late their commit arrived, get new ones, and the gaps that the committed intervals leave are run and
    committed with their output. A head hash that is null is pending. Empty tables give an empty result.
    """
    spark = tree_files.sparkSession
    ledger = ledger or Ledger(spark, tracked(spark, f"{shared_dir(spark)}/lodeseam/ledger-{uuid.uuid4().hex}"), ["repo_id", "block"], ["path", "hash"])
    state = indexed_state(indexed_files).withColumnRenamed("indexed_hash", "hash").filter("hash is not null")
    pick = lambda df: df.select("repo_id", "path")
    ledger.run(file_records(state, blocks), lambda df: pick(df).limit(0))
    number = ledger.run(file_records(head_files(tree_files), blocks), pick)
    return ledger.output_of(number)


class Ledger:
    """Durable numbers, intervals and outputs under one folder of the shared file system.

    keys: the columns of a sequence. identity: the columns that name a record in it, if the ledger is to number records
    itself; a record processed once stays processed, so identity must tell versions apart that are to be run again.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], identity: list[str] | None = None) -> None:
        self.spark, self.folder, self.keys, self.identity = spark, folder.rstrip("/"), keys, identity or []
        self.manifest = Manifest(spark, self.folder)

    def state(self) -> dict:
        return {"runs": [], "numbers": [], "intervals": None, **self.manifest.current()}

    def processed(self, like: DataFrame) -> DataFrame:
        """(keys, lo, hi) of all committed runs; `like` gives the types of the keys."""
        run = self.state()["intervals"]
        if run is None:
            return like.select(*self.keys, F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi")).limit(0)
        return self.spark.read.parquet(f"{self.folder}/{run}/intervals")

    def output(self) -> DataFrame | None:
        runs = self.state()["runs"]
        return self.spark.read.parquet(*[f"{self.folder}/{r}/output" for r in runs]) if runs else None

    def output_of(self, number: int) -> DataFrame:
        """The output that commit `number` added."""
        return self.spark.read.parquet(f"{self.folder}/{self.state()['runs'][number - 1]}/output")

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _numbers(self, records: DataFrame, before: dict, run: str) -> DataFrame:
        """(keys, identity, seq) of all records ever seen; those first seen now come after the last of their sequence."""
        seen = records.select(*self.keys, *self.identity).distinct()
        if not before["numbers"]:
            known = seen.withColumn("seq", F.lit(0).cast("long")).limit(0)
        else:
            known = self.spark.read.parquet(*[f"{self.folder}/{r}/numbers" for r in before["numbers"]])
        tops = known.groupBy(*self.keys).agg(F.max("seq").alias("top"))
        fresh = join_null_safe(seen, known.drop("seq"), [*self.keys, *self.identity], "left_anti")
        order = Window.partitionBy(*self.keys).orderBy(*self.identity)
        placed = join_null_safe(fresh.withColumn("_place", F.row_number().over(order)), tops, self.keys, "left")
        new = placed.select(*self.keys, *self.identity, (F.coalesce("top", F.lit(0)) + F.col("_place")).cast("long").alias("seq"))
        return known.unionByName(self._written(new, f"{self.folder}/{run}/numbers"))

    def run(self, records: DataFrame, process: Callable[[DataFrame], DataFrame]) -> int:
        """Process the records (keys, seq or identity, ...) that aren't yet covered; returns the number of the commit."""
        before = self.state()
        name = f"run-{uuid.uuid4().hex}"
        if self.identity:
            numbers = self._numbers(records, before, name)
            records = join_null_safe(records.drop("seq"), numbers, [*self.keys, *self.identity], "inner")
        done = self.processed(records)
        gaps = subtract(intervals(records, self.keys), done, self.keys)
        gaps = self._written(gaps, f"{self.folder}/{name}/gaps")
        fresh = join_null_safe(records, expand(gaps, self.keys), [*self.keys, "seq"], "left_semi").dropDuplicates([*self.keys, "seq"])
        process(fresh).write.parquet(f"{self.folder}/{name}/output")
        merge(done.unionByName(gaps), self.keys).write.parquet(f"{self.folder}/{name}/intervals")
        after = {"runs": [*before["runs"], name], "numbers": [*before["numbers"], *([name] if self.identity else [])], "intervals": name}
        return self.manifest.commit(before, after)
