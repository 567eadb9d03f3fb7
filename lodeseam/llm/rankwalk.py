"""One ranking from several scores on different scales, by a rank-walk Markov chain.

From an item the walk picks one of the query's lists at random and jumps to an item drawn evenly from those the list
scores at least as high (itself and its ties among them); an item the list doesn't score jumps to any item of the list.
Only the order within a list matters, so no list dominates by its range. The stationary distribution is found by power
iteration with damping: with every list sorted once, a step is a prefix sum over each list, linear in its length.

A query's lists are solved together in one task while they have at most `local_rows` rows; the rest go through the same
step written as joins and windows over bounded blocks of each list (`solve_blocks`), whatever their size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_key, materialize

DAMPING, TOLERANCE, MAX_STEPS = 0.9, 1e-10, 200
#: Rows of one query's lists solved in one task (about 40 MB there).
LOCAL_ROWS = 300_000


def ranked_lists(lists: DataFrame) -> DataFrame:
    """(query_id, list, item, score): one row per scored item and list; null or NaN scores mean "not scored", of repeats the best counts."""
    return (
        lists.filter(F.col("query_id").isNotNull() & F.col("list").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
        .groupBy("query_id", "list", "item")
        .agg(F.max("score").alias("score"))
    )


def walk(lists: list[tuple[np.ndarray, np.ndarray]], n: int, damping: float = DAMPING) -> np.ndarray:
    """Stationary probabilities of n items; a list is (item numbers, scores)."""
    prepared = []
    for items, scores in lists:
        order = np.argsort(scores, kind="stable")
        items, scores = items[order], scores[order]
        first = np.searchsorted(scores, scores, side="left")  # items before the ties of this one
        last = np.searchsorted(scores, scores, side="right") - 1
        prepared.append((items, 1.0 / (len(items) - first), last))
    p = np.full(n, 1.0 / n)
    for _ in range(MAX_STEPS):
        new = np.zeros(n)
        for items, share, last in prepared:
            mass = p[items]
            new[items] += np.cumsum(mass * share)[last] + (1.0 - mass.sum()) / len(items)
        new = damping * new / len(prepared) + (1.0 - damping) / n
        new /= new.sum()
        if np.abs(new - p).sum() < TOLERANCE:
            return new
        p = new
    return p


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    items, number = np.unique(rows["item"].to_numpy(), return_inverse=True)
    codes = rows["list"].astype("category").cat.codes.to_numpy()
    score = rows["score"].to_numpy(float)
    p = walk([(number[codes == c], score[codes == c]) for c in range(codes.max() + 1)], len(items))
    return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "item": items, "weight": p})


def solve_blocks(lists: DataFrame, steps: int = MAX_STEPS, damping: float = DAMPING) -> DataFrame:
    """The same chain for queries of any size: (query_id, item, weight).

    Distinct scores of each list are range-partitioned into blocks; prefix sums run within a block, and over the sums of
    the blocks. Ties are summed before, so a block is never larger than its partition.
    """
    key = ["query_id", "list"]
    dist = materialize(lists.groupBy(*key, "score").agg(F.count("*").alias("ties")).repartitionByRange(*[F.col(c) for c in (*key, "score")]).withColumn("block", F.spark_partition_id()), "blocks")

    def prefix(values: DataFrame) -> DataFrame:
        """values: (query_id, list, block, score, x) -> with `upto`, the sum of x over scores up to this one."""
        inner = values.withColumn("within", F.sum("x").over(Window.partitionBy(*key, "block").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)))
        sums = values.groupBy(*key, "block").agg(F.sum("x").alias("s"))
        before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("s")
        return inner.join(before, [*key, "block"]).withColumn("upto", F.col("within") + F.col("before")).drop("within", "before")

    size = dist.groupBy(*key).agg(F.sum("ties").alias("n_list"))
    ranked = prefix(dist.withColumn("x", F.col("ties").cast("double"))).join(size, key)
    ranked = materialize(ranked.select(*key, "block", "score", "n_list", (F.col("n_list") - F.col("upto") + F.col("ties")).alias("n_ge")), "ranked")
    entries = materialize(lists.join(ranked, [*key, "score"]), "entries")
    counts = lists.groupBy("query_id").agg(F.countDistinct("list").alias("n_lists"), F.countDistinct("item").alias("n_items"))
    items = materialize(lists.select("query_id", "item").distinct().join(counts, "query_id"), "items")
    p = items.withColumn("weight", 1.0 / F.col("n_items"))
    for _ in range(steps):
        mass = entries.join(p.select("query_id", "item", "weight"), ["query_id", "item"])
        by_score = mass.groupBy(*key, "block", "score", "n_ge", "n_list").agg(F.sum(F.col("weight") / F.col("n_ge")).alias("x"), F.sum("weight").alias("own"))
        held = by_score.groupBy(*key).agg(F.sum("own").alias("held"))
        step = prefix(by_score).join(held, key).withColumn("gain", F.col("upto") + (1.0 - F.col("held")) / F.col("n_list"))
        gained = entries.join(step.select(*key, "score", "gain"), [*key, "score"]).groupBy("query_id", "item").agg(F.sum("gain").alias("gain"))
        new = materialize(items.join(gained, ["query_id", "item"]).withColumn("weight", damping * F.col("gain") / F.col("n_lists") + (1.0 - damping) / F.col("n_items")), "walk")
        moved = new.join(p.select("query_id", "item", F.col("weight").alias("old")), ["query_id", "item"]).groupBy("query_id").agg(F.sum(F.abs(F.col("weight") - F.col("old"))).alias("d")).agg(F.max("d")).first()[0]
        p = new
        if moved is None or moved < TOLERANCE:
            break
    return p.select("query_id", "item", "weight")


def rank(lists: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(query_id, item, weight): every item of each query with its stationary probability; a greater one ranks first, equal ones go by item.

    lists: (query_id, list, item, score), a higher score being better. Null keys and scores are left out, repeats count
    once, an empty table gives an empty ranking, other columns are ignored.
    """
    clean = ranked_lists(lists)
    sizes = clean.groupBy("query_id").agg(F.count("*").alias("n"))
    large = [r.query_id for r in sizes.filter(F.col("n") > local_rows).limit(1).collect()]
    kind = lists.schema
    schema = f"query_id {kind['query_id'].dataType.simpleString()}, item {kind['item'].dataType.simpleString()}, weight double"
    if not large:
        out = by_key(clean, "query_id").groupBy("query_id").applyInPandas(_solve, schema)
    else:
        sized = materialize(clean.join(sizes, "query_id"), "lists")
        out = sized.filter(F.col("n") <= local_rows).drop("n").groupBy("query_id").applyInPandas(_solve, schema)
        out = out.unionByName(solve_blocks(sized.filter(F.col("n") > local_rows).drop("n")))
    return out


def top_k(weights: DataFrame, queries: DataFrame) -> DataFrame:
    """The first k items of each query: (query_id, item, weight, rank). Queries with null or non-positive k get none."""
    k = queries.filter(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.max("k").alias("k"))
    most = k.agg(F.max("k")).first()[0] or 0  # a constant bound lets every task keep only its first rows before the shuffle
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), F.asc("item"))
    ranked = weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.join(k, "query_id").filter(F.col("rank") <= F.col("k")).select("query_id", "item", "weight", "rank")
