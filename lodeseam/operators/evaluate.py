"""Evaluation of rankings against expected paths, and summaries of telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def first_hits(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, hit_rank): for each case the first rank with the expected path and, if given, text; null for a miss.

    results: (query_id, rank, path, snippet); cases: (query_id, expected_path, expected_text).
    """
    text_ok = F.coalesce("expected_text", F.lit("")) == ""
    found = (F.col("path") == F.col("expected_path")) & (text_ok | F.contains(F.lower("snippet"), F.lower("expected_text")))
    hits = results.join(cases, "query_id").filter(found).groupBy("query_id").agg(F.min("rank").alias("hit_rank"))
    return cases.select("query_id").join(hits, "query_id", "left")


def recall(hits: DataFrame, k: int) -> DataFrame:
    """One row: cases, hits, recall at k and mean reciprocal rank; zeros without cases."""
    inside = F.col("hit_rank") <= k
    return hits.agg(
        F.count("*").alias("total"),
        F.count_if(inside).alias("hits"),
        F.coalesce(F.avg(F.when(inside, 1.0).otherwise(0.0)), F.lit(0.0)).alias("recall_at_k"),
        F.coalesce(F.avg(F.when(inside, 1.0 / F.col("hit_rank")).otherwise(0.0)), F.lit(0.0)).alias("mrr"),
    )


def telemetry(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: count, mean, p50, p95 and maximum of the values that are numbers; a percentile is the value at place
    floor((n - 1) * share) in order, without interpolation.

    Distinct values are counted, range-partitioned into blocks and summed within a block and over the blocks: no group's
    values are gathered in one place.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    totals = counts.groupBy(key).agg(F.sum("c").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), F.max(value).alias("maximum"))
    blocks = materialize(counts.repartitionByRange(key, value).withColumn("block", F.spark_partition_id()), "counts")
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(key, "block").agg(F.sum("c").alias("s")).select(key, "block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"))
    within = F.sum("c").over(Window.partitionBy(key, "block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = blocks.withColumn("within", within).join(sums, [key, "block"]).withColumn("upto", F.col("before") + F.col("within")).join(totals, key)
    at = lambda share: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * F.lit(share)), F.col(value)))
    return placed.groupBy(key, "n", "mean", "maximum").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


def value_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, n): how often each value of the string columns `keys` occurs; nulls don't count."""
    melted = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("e")).select("e.*")
    return melted.filter("value is not null").groupBy("key", "value").agg(F.count("*").alias("n"))


def expected_rank(scores: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, best_score, expected_rank): the best score of the expected path and its place among all scores."""
    best = scores.join(cases.select("query_id", "expected_path"), "query_id").filter(F.col("path") == F.col("expected_path")).groupBy("query_id").agg(F.max("score").alias("best_score"))
    above = scores.join(best, "query_id").groupBy("query_id", "best_score").agg((F.count_if(F.col("score") > F.col("best_score")) + 1).alias("expected_rank"))
    return above
