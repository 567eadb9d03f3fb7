"""Mixing sources to target shares by Poisson replication.

Every document draws its number of copies by inverting a Poisson distribution at a uniform number hashed from its id and
a seed, cut off at the source's cap. The mean of the cut-off distribution is set to the rate the source needs, so caps
don't bias the shares; a source that needs its cap or more uses every document exactly that often.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _poisson(lam: float, cap: int) -> np.ndarray:
    """P(X = 0), ... P(X = cap - 1), by logarithms: no rate is too great."""
    k = np.arange(cap)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, cap)))])[:cap]
    return np.exp(k * math.log(lam) - lam - logs) if lam > 0 else (k == 0).astype(float)


def _cut_mean(lam: float, cap: int) -> float:
    """E[min(X, cap)] of a Poisson X."""
    return float((1.0 - np.minimum(np.cumsum(_poisson(lam, cap)), 1.0)).sum())


def cut_poisson(rate: float, cap: int) -> list[float]:
    """P(X <= 0), ... P(X <= cap - 1) of the Poisson distribution that has mean `rate` when cut off at cap."""
    if rate <= 0:
        return [1.0] * cap
    if rate >= cap:
        return [0.0] * cap
    low, high = 0.0, 2.0 * cap
    while _cut_mean(high, cap) < rate and high < 1e6 * cap:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _cut_mean(mid, cap) < rate else (low, mid)
    return np.minimum(np.cumsum(_poisson(low, cap)), 1.0).tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _cdf(rate: pd.Series, cap: pd.Series) -> pd.Series:
    return pd.Series([cut_poisson(float(r), int(c)) for r, c in zip(rate.fillna(0.0), cap.fillna(0))])


def uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) hashed from the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) * F.lit(2.0**-53)


def source_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of targets: size, rate and shortfall.

    sizes: (source, size) of each document; rows of unlisted or null sources and null sizes don't count. targets:
    (source, target_share, max_repeats); repeated rows count once, null shares are 0, null caps 1. A source without
    documents has size 0, and falls short if its share is above 0.
    """
    listed = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    by_source = sizes.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("size").alias("size"), F.count("size").alias("n_docs"))
    rows = listed.join(by_source, "source", "left").fillna(0, ["size", "n_docs"])
    total = rows.agg(F.sum("size").alias("total"))
    wanted = F.col("target_share") * F.col("total")
    return (
        rows.crossJoin(F.broadcast(total))  # one row
        .withColumn("rate", F.when(F.col("size") > 0, wanted / F.col("size")).when(wanted > 0, F.col("max_repeats")).otherwise(0.0))
        .withColumn("falls_short", F.col("size") * F.col("max_repeats") < wanted)
    )


def mix(sizes: DataFrame, rates: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, copy_no, position): every use of every document, in globally shuffled order of position.

    The explosion is local to each row: no source, however large, is gathered anywhere. position is hashed, so sorting
    or range-partitioning by it is the global shuffle, the same in every run with the same seed.
    """
    plan = rates.select("source", "max_repeats", _cdf("rate", "max_repeats").alias("cdf"))
    u = uniform(F.col("doc_id"), F.lit(seed))
    uses = F.size(F.filter("cdf", lambda c: u >= c))
    return (
        sizes.join(plan, "source")
        .withColumn("copy_no", F.explode(F.when(uses > 0, F.sequence(F.lit(1), uses))))
        .withColumn("position", F.xxhash64("doc_id", "copy_no", F.lit(seed + 1)))
        .select("doc_id", "source", "size", "copy_no", "position")
    )


def shares(mixed: DataFrame, rates: DataFrame) -> DataFrame:
    """Target and reached share of every source, of the planned total and of the mixture itself, and whether the mixture
    falls short of its share though it holds every document of the source max_repeats times."""
    got = mixed.groupBy("source").agg(F.sum("size").alias("mixed_size"), F.count("size").alias("uses"))
    rows = rates.select("source", "target_share", "max_repeats", "size", "n_docs", "rate", "total").join(got, "source", "left").fillna(0, ["mixed_size", "uses"])
    spent = F.col("uses") == F.col("n_docs") * F.col("max_repeats")
    rows = rows.withColumn("falls_short", spent & (F.col("mixed_size") < F.col("target_share") * F.col("total")))
    mixed_total = rows.agg(F.sum("mixed_size").alias("mixed_total"))
    rows = rows.crossJoin(F.broadcast(mixed_total))  # one row
    rows = rows.withColumn("share_of_planned", F.when(F.col("total") > 0, F.col("mixed_size") / F.col("total")).otherwise(0.0))
    return rows.withColumn("reached_share", F.when(F.col("mixed_total") > 0, F.col("mixed_size") / F.col("mixed_total")).otherwise(0.0)).drop("mixed_total", "total", "n_docs")
