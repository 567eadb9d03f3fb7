"""Most similar vectors, by collision-counting hashing.

A vector's projections on random lines are its hash values. Two vectors collide on a line when the values lie within a
window centred on one of them; the nearer they are, the more lines they collide on, and only pairs that collide on a
threshold of lines are compared exactly. Widening the window (virtual rehashing) reaches greater distances with the same
values; no hash is computed again.

All pairs above a similarity: so that no line is scanned by all vectors, they are first spread over cells by the signs of
a few further projections, in several tables; in every cell the vectors lie sorted by one projection, and each is counted
against those in the window that follows it. The number of signs grows with the logarithm of the collection, so a cell
keeps its size; the number of tables grows with the signs, so that the chance that a pair at the threshold shares a cell
stays the same whatever the collection's size. The tables are gone through a share at a time, so that the disk that their
sorting takes doesn't grow with their number. Equal vectors are one class and hashed once.

For a threshold the last radius decides which pairs collide, so the window of a vector widens, neighbour by neighbour,
up to that radius at once; the radii between would only bring the same pairs earlier.

Top k of a stated query set: blocks of queries lie in the shared folder, and one scan of the vectors holds each of its
batches against every block. A batch is sorted once by each line; the windows of a query widen through the radii, counting
only what each widening adds, until k vectors within the radius are found or the radius passes the k-th best already
known; a query for which the last radius isn't enough is compared with the batch exactly.
"""

from __future__ import annotations

import functools
import io
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize, shared_dir, spread, tracked

SEED = 20240601
#: Steps of the stored projections per unit; a byte each.
STEPS = 24
#: What rounding to a byte a component may take from a cosine (nine standard deviations).
ROUNDING = 0.01


class Plan(NamedTuple):
    dims: int = 64
    lines: int = 32  # projections counted
    collisions: int = 25  # of the lines, for a pair to be compared
    tables: int = 24  # of cells, at least
    at_once: int = 12  # tables that are sorted at once
    missed: float = 1e-3  # chance that a pair at the threshold shares no cell: sets the number of tables
    cell: int = 48  # vectors in a cell on average
    width: float = 2.0  # half a window, in units of the radius
    reach: float = 3.5  # of the window on the line that cells are sorted by: a pair missed there is missed in every table
    block: int = 2048  # queries at once
    batch: int = 16384  # vectors sorted at once for them


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """(id, model, vector) of rows that count: repeated ids once; null, short, long, all-zero and non-finite vectors never."""
    rows = vectors.filter(F.col("id").isNotNull() & F.col("model").isNotNull() & (F.size("vector") == dims))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.filter(~F.exists("vector", lambda x: x.isNull() | F.isnan(x))).filter((norm > 0) & (norm < F.lit(float("inf"))))
    return rows.select("id", "model", F.col("vector").cast("array<double>").alias("vector")).dropDuplicates(["id"])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _lines(plan: Plan) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((plan.dims, plan.lines)).astype(np.float32)


def project(x: np.ndarray, plan: Plan) -> np.ndarray:
    """The values on all lines, in steps; int8."""
    return np.clip(np.rint(x @ _lines(plan) * STEPS), -127, 127).astype(np.int8)


def classes(rows: DataFrame) -> DataFrame:
    """(id, rep): equal vectors of a model share their least id."""
    marks = rows.select("id", "model", F.xxhash64("vector").alias("h1"), F.xxhash64(F.reverse("vector"), F.lit(1)).alias("h2"))
    reps = materialize(marks.groupBy("model", "h1", "h2").agg(F.min("id").alias("rep")), "reps")
    return materialize(marks.join(reps, ["model", "h1", "h2"]).select("id", "rep"), "members")


def tables_needed(bits: int, least_cosine: float, plan: Plan) -> int:
    """Tables of cells by `bits` signs in which a pair at `least_cosine` shares a cell with a chance of 1 - `missed`."""
    agree = (1.0 - np.arccos(np.clip(least_cosine, -1.0, 1.0)) / np.pi) ** bits
    return plan.tables if agree >= 1.0 else max(plan.tables, int(np.ceil(np.log(plan.missed) / np.log1p(-agree))))


def placed(reps: DataFrame, plan: Plan, bits: int, first: int = 0, last: int | None = None) -> DataFrame:
    """(cell, p0, id, rounded) of every vector in the tables from `first` to before `last`; rounded: a byte a component."""
    numbers = np.arange(first, plan.tables if last is None else last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.concatenate([np.random.default_rng([SEED + 1, t]).standard_normal((plan.dims, bits)) for t in numbers.tolist()], axis=1).astype(np.float32)
        weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64))[None, None, :]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column(2), plan.dims)
                p0 = project(x, plan)[:, 0].astype(np.int32)
                rounded = np.rint(x * (127.0 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)
                signs = (x @ planes > 0).reshape(len(x), len(numbers), bits)
                cell = (signs * weights).sum(axis=2, dtype=np.uint64)
                salt = np.array([hash_text(m) for m in part.column(1).to_pylist()], np.uint64)[:, None]
                with np.errstate(over="ignore"):
                    cell = (cell + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (salt + numbers.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
                    cell = (cell ^ (cell >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(plan.dims), len(x), [None, pa.py_buffer(rounded.tobytes())]).cast(pa.binary())
                take = pa.array(np.repeat(np.arange(len(x)), len(numbers)))
                yield pa.record_batch(
                    [pa.array(cell.reshape(-1).view(np.int64)), pa.array(np.repeat(p0, len(numbers))), part.column(0).take(take), raw.take(take)], ["cell", "p0", "id", "rounded"]
                )

    return reps.select("id", "model", "vector").mapInArrow(run, "cell long, p0 int, id long, rounded binary")


def hash_text(text: str) -> int:
    out = 0xCBF29CE484222325
    for b in text.encode():
        out = (out ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return out


def count_pairs(cell: np.ndarray, p0: np.ndarray, values: np.ndarray, fresh: int, width: int, least: int, reach: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (their numbers) sorted by (cell, p0) of one cell, within the window on the first line and colliding
    on at least `least` lines; the later row of a pair is at `fresh` or after it."""
    n, half = len(cell), values.shape[1] // 2
    reach = width if reach is None else reach
    may_miss = values.shape[1] - least
    first = np.arange(n)
    step = 1
    while len(first):
        first = first[first + step < n]
        second = first + step
        alive = (cell[second] == cell[first]) & (p0[second] - p0[first] <= reach)
        first, second = first[alive], second[alive]
        new = second >= fresh
        for at in range(0, int(new.sum()), 200_000):
            a, b = first[new][at : at + 200_000], second[new][at : at + 200_000]
            # lines are counted in two halves; pairs that can't reach the threshold any more end after the first
            missed = (np.abs(values[a, :half].astype(np.int16) - values[b, :half]) > width).sum(axis=1)
            open_ = missed <= may_miss
            a, b, missed = a[open_], b[open_], missed[open_]
            keep = missed + (np.abs(values[a, half:].astype(np.int16) - values[b, half:]) > width).sum(axis=1) <= may_miss
            if keep.any():
                yield a[keep], b[keep]
        step += 1


def _written(df: DataFrame, label: str) -> DataFrame:
    """df, written; the shuffles behind it leave the disk at once."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return materialize(df, label)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def similar_pairs(vectors: DataFrame, least_cosine: float = 0.9, plan: Plan = Plan()) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, cosine) of class representatives, a < b, of the same model and with cosine at least
    `least_cosine`; members (id, rep).

    vectors: (id long, model, vector). Unusable vectors never count; an empty table gives empty results.
    """
    rows = materialize(usable(vectors, plan.dims), "vectors")
    members = classes(rows)
    reps = rows.join(broadcast_if_small(members.filter(F.col("id") == F.col("rep")).select("id")), "id", "left_semi")
    most = rows.groupBy("model").count().agg(F.max("count")).first()[0] or 1
    bits = max(1, min(60, round(float(np.log2(max(2.0, most / plan.cell))))))
    tables = tables_needed(bits, least_cosine, plan)
    radius = float(np.sqrt(2.0 - 2.0 * least_cosine))
    width, reach = int(np.ceil(plan.width * radius * STEPS)), int(np.ceil(plan.reach * radius * STEPS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the rows of the last cell that a later row may still be near
        for batch in batches:
            cell, p0, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int8).reshape(-1, plan.dims).astype(np.float32)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            fresh = 0
            if held is not None:
                fresh = len(held[0])
                cell, p0, ids, x = (np.concatenate(parts) for parts in zip(held, (cell, p0, ids, x)))
            if not len(cell):
                continue
            for a, b in count_pairs(cell, p0, project(x, plan), fresh, width, plan.collisions, reach):
                # what collides often enough is held against the threshold on the rounded vectors, then on the vectors
                alike = np.einsum("ij,ij->i", x[a], x[b]) >= least_cosine - ROUNDING
                a, b = ids[a[alike]], ids[b[alike]]
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            near = (cell == cell[-1]) & (p0[-1] - p0 <= reach)
            held = [cell[near], p0[near], ids[near], x[near]]

    reps = materialize(reps, "classes") if tables > plan.at_once else reps
    pairs = None
    for group in np.array_split(np.arange(tables), -(-tables // plan.at_once)):
        sorted_ = placed(reps, plan, bits, int(group[0]), int(group[-1]) + 1).repartition("cell").sortWithinPartitions("cell", "p0")
        some = _written(sorted_.mapInArrow(count, "a long, b long").distinct(), "candidates")
        pairs = some if pairs is None else pairs.unionByName(some)
    if tables > plan.at_once:
        pairs = _written(pairs.distinct(), "candidates")
    needed = broadcast_if_small(materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "needed"))
    near = rows.join(needed, "id", "left_semi")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    both = pairs.join(near.select(F.col("id").alias("a"), F.col("model").alias("ma"), F.col("vector").alias("va")), "a").join(near.select(F.col("id").alias("b"), F.col("model").alias("mb"), F.col("vector").alias("vb")), "b")
    cosine = (dot / (norm("va") * norm("vb"))).alias("cosine")
    found = both.filter("ma = mb").select("a", "b", cosine).filter(F.col("cosine") >= least_cosine)
    return found, members


def expand(found: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), smaller first, of all vectors: pairs between classes and within them."""
    left, right = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = found.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    copies = members.filter(F.col("id") != F.col("rep")).select("rep").distinct()
    own = members.join(copies, "rep", "left_semi").select("rep", F.col("id").alias("x"))
    within = own.join(own.select("rep", F.col("x").alias("y")), "rep").filter("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def write_blocks(asked: DataFrame, plan: Plan) -> tuple[str, list[tuple[str, str]]]:
    """Queries (id, model, vector) in files of about plan.block of one model in the shared folder: (folder, (model, file))."""
    spark = asked.sparkSession
    folder = tracked(spark, f"{shared_dir(spark)}/lodeseam/queries-{uuid.uuid4().hex}")
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    sizes = asked.groupBy("model").agg(F.ceil(F.count("*") / plan.block).alias("parts"))
    parted = asked.join(F.broadcast(sizes), "model").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))  # as many rows as models

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        model = str(rows["model"].iloc[0])
        name = f"{hash_text(model)}-{rows['part'].iloc[0]}"
        buffer = io.BytesIO()
        np.savez(buffer, ids=rows["id"].to_numpy(np.int64), x=_unit(np.stack(rows["vector"].to_numpy())))
        out, at = fs.FileSystem.from_uri(folder)
        part = f"{at}/.{name}-{uuid.uuid4().hex}"
        with out.open_output_stream(part) as f:
            f.write(buffer.getvalue())
        out.move(part, f"{at}/{name}")
        return pd.DataFrame({"model": [model], "name": [name]})

    made = parted.groupBy("model", "part").applyInPandas(write, "model string, name string")
    return folder, [(r.model, r.name) for r in made.collect()]  # names, one for 2,048 queries


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@functools.lru_cache(maxsize=8)
def _block(folder: str, name: str, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, values on the lines) of a block of queries."""
    files, path = fs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{path}/{name}") as f:
        held = np.load(io.BytesIO(f.read()))
    return held["ids"], held["x"], project(held["x"], plan)


def search_block(ids: np.ndarray, x: np.ndarray, query: tuple[np.ndarray, np.ndarray, np.ndarray], best: tuple[np.ndarray, np.ndarray], k: int, radii: tuple[float, ...], plan: Plan) -> None:
    """Bring `best` (ids and cosines, k of each query, best first) up to date with the vectors of a batch."""
    qid, qx, qv = query
    best_id, best_cos = best
    v = project(x, plan)
    order = np.argsort(v, axis=0, kind="stable")
    ordered = np.take_along_axis(v, order, axis=0).astype(np.int16)
    widths = [int(1.5 * r * STEPS) for r in radii]
    lo = np.empty((len(radii), plan.lines, len(qid)), np.int64)
    hi = np.empty_like(lo)
    for j in range(plan.lines):
        centre = qv[:, j].astype(np.int16)
        for r, w in enumerate(widths):
            lo[r, j] = np.searchsorted(ordered[:, j], centre - w, "left")
            hi[r, j] = np.searchsorted(ordered[:, j], centre + w, "right")
    exact = []

    def take(i: int, at: np.ndarray, cosine: np.ndarray) -> None:
        other = ids[at] != qid[i]
        all_id, all_cos = np.concatenate([best_id[i], ids[at][other]]), np.concatenate([best_cos[i], cosine[other]])
        first = np.lexsort((all_id, -all_cos))[:k]
        best_id[i], best_cos[i] = all_id[first], all_cos[first]

    for i in range(len(qid)):
        count = np.zeros(len(ids), np.int32)
        done = np.zeros(len(ids), bool)
        a = b = lo[0, :, i]
        for r, radius in enumerate(radii):
            begin, end = lo[r, :, i], hi[r, :, i]
            # what this widening adds on both sides of each window
            ring = [order[begin[j] : a[j], j] for j in range(plan.lines)] + [order[b[j] : end[j], j] for j in range(plan.lines)]
            count += np.bincount(np.concatenate(ring), minlength=len(ids)).astype(np.int32)
            a, b = begin, end
            at = np.flatnonzero((count >= plan.collisions) & ~done)
            done[at] = True
            take(i, at, x[at] @ qx[i])
            if best_cos[i, -1] >= 1 - radius * radius / 2:
                break
        else:
            exact.append(i)
    for part in np.array_split(np.array(exact, np.int64), max(1, len(exact) // 256)):
        cosine = qx[part] @ x.T
        near = np.argpartition(-cosine, min(k, len(ids) - 1), axis=1)[:, : k + 1]
        for i, row, at in zip(part.tolist(), cosine, near):
            at = at[~np.isin(ids[at], best_id[i])]
            take(i, at, row[at])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, plan: Plan = Plan(collisions=24), radii: tuple[float, ...] = (0.3, 0.45, 0.63)) -> DataFrame:
    """(id, neighbour, cosine, rank): the k most similar other vectors of the same model for every query id.

    queries: (id). Every query is held against every vector of the collection, in one scan. Ties go by the lesser id; a
    query with fewer than k others of its model gets those. Unusable query vectors have no neighbours.
    """
    rows = materialize(usable(vectors, plan.dims), "vectors")
    asked = rows.join(broadcast_if_small(queries.select("id").distinct()), "id", "left_semi")
    folder, blocks = write_blocks(asked, plan)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[str, list] = {}

        def flush(model: str) -> None:
            ids = np.concatenate([i for i, _ in held[model]])
            x = np.concatenate([v for _, v in held[model]])
            held[model] = []
            for name in [n for m, n in blocks if m == model]:
                query = _block(folder, name, plan)
                if name not in best:
                    best[name] = (np.full((len(query[0]), k), np.iinfo(np.int64).max), np.full((len(query[0]), k), -2.0, np.float32))
                search_block(ids, x, query, best[name], k, radii, plan)

        for batch in batches:
            ids, models, x = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object), _matrix(batch.column(2), plan.dims)
            for model in dict.fromkeys(models.tolist()):
                mine = models == model
                held.setdefault(model, []).append((ids[mine], x[mine]))
                if sum(len(i) for i, _ in held[model]) >= plan.batch:
                    flush(model)
        for model in [m for m, parts in held.items() if parts]:
            flush(model)
        for name, (best_id, best_cos) in best.items():
            known = best_cos > -1.5
            asked_id = np.repeat(_block(folder, name, plan)[0], k).reshape(-1, k)
            yield pa.record_batch([pa.array(asked_id[known]), pa.array(best_id[known]), pa.array(best_cos[known].astype(np.float64))], ["id", "neighbour", "cosine"])

    found = spread(rows.select("id", "model", "vector")).mapInArrow(search, "id long, neighbour long, cosine double")
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
