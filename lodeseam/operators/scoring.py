"""Scoring of a set of queries against all chunks, a batch of chunks at a time.

What a score needs of a chunk (which of the queries' terms its fields hold, its vector, its BM25 where it has any) is a
narrow row; a batch of rows against all queries is a few matrix products. Of every batch only the rows that can be among
the first of a query leave it, so nothing of the size queries times chunks is ever shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401


class Queries(NamedTuple):
    """The queries as arrays; `terms` numbers the terms of all, `holds` has a row of 0 and 1 over them for each."""

    ids: list
    terms: dict[str, int]
    holds: np.ndarray
    sizes: np.ndarray
    lower: list[str]
    vectors: np.ndarray | None
    docs: np.ndarray
    tests: np.ndarray
    keep: np.ndarray  # rows of each query that may be asked for
    repos: list[str]  # a repository each query is confined to, '' for none


def incidence(column: pa.Array, terms: dict[str, int]) -> np.ndarray:
    """0 and 1: which terms each row's list holds; words that are none of the terms don't matter."""
    out = np.zeros((len(column), max(1, len(terms))), np.float32)
    lengths = np.asarray(column.value_lengths().fill_null(0))
    at = np.array([terms.get(t, -1) for t in column.flatten().to_pylist()], np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row[at >= 0], at[at >= 0]] = 1.0
    return out


def pair_values(column: pa.Array, n: int, field: str | None) -> np.ndarray:
    """A matrix from a column of lists of (query number, value) pairs; or of where there is any pair, without a field."""
    out = np.zeros((len(column), n))
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    if len(flat):
        rows = np.repeat(np.arange(len(column)), lengths)
        numbers = np.asarray(flat.field("q") if field else flat)
        out[rows, numbers] = np.asarray(flat.field(field)) if field else 1.0
    return out


def share(held: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.divide(held, sizes, out=np.zeros_like(held), where=sizes > 0)


def cosines(column: pa.Array, queries: np.ndarray) -> np.ndarray:
    x = np.asarray(column.flatten()).reshape(len(column), -1)
    length = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((queries * queries).sum(axis=1))[None, :]
    return np.divide(x @ queries.T, length, out=np.zeros(length.shape), where=length > 0)


def names_symbol(symbols: list[str], queries: list[str]) -> np.ndarray:
    """Where a query's text holds the symbol's name; each distinct name is looked for once."""
    rows = {s: np.array([s in q for q in queries], bool) for s in set(symbols)}
    return np.stack([rows[s] for s in symbols]) if symbols else np.zeros((0, len(queries)), bool)


def holds_query(values: list[str], queries: list[str]) -> np.ndarray:
    """Where a value holds a query's text; each distinct value is looked at once."""
    rows = {v: np.array([q != "" and q in v for q in queries], bool) for v in set(values)}
    return np.stack([rows[v] for v in values]) if values else np.zeros((0, len(queries)), bool)


def fixed_order(batch: pa.RecordBatch, columns: list[tuple[str, bool]]) -> np.ndarray:
    """The place of each row in the order of the columns (name, descending) that breaks ties."""
    at = pa.compute.sort_indices(pa.table({n: batch.column(n) for n, _ in columns}), [(n, "descending" if d else "ascending") for n, d in columns])
    out = np.empty(batch.num_rows, np.int64)
    out[np.asarray(at)] = np.arange(batch.num_rows)
    return out


def first_rows(score: np.ndarray, tie: np.ndarray, allowed: np.ndarray, keep: int, files: np.ndarray | None, per_file: int) -> np.ndarray:
    """Of one query the rows that can be among its first `keep`: the first of all, and the first of those that are among
    the first `per_file` of their file in this batch (a row among a query's first is in one of both)."""
    rows = np.flatnonzero(allowed)
    order = rows[np.lexsort((tie[rows], -score[rows]))]
    first = order[:keep]
    if files is None or len(order) <= keep:
        return first
    by_file = np.argsort(files[order], kind="stable")
    sorted_files = files[order][by_file]
    starts = np.flatnonzero(np.append(True, sorted_files[1:] != sorted_files[:-1]))
    place = np.empty(len(order), np.int64)
    place[by_file] = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return np.union1d(first, order[place < per_file][:keep])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
