"""Retrieval over a table of chunks for a table of queries: postings and BM25, vector and exact lists, hybrid scoring,
rank fusion, diversification. Every operator takes all queries at once; a single query is a table of one row.

queries: (query_id, query_text, ...); chunks: one row per chunk_id. Scores carry only keys and score inputs up to the
ranking; contents are joined back for the rows that remain.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths, text, vectors
from ..session import broadcast_if_small, materialize, spread
from . import scoring

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K, TOP_BONUS, NEAR_BONUS = 60, 0.05, 0.02
FTS_LIMIT, UNION_FTS_LIMIT, VECTOR_LIMIT, EXACT_LIMIT, OVERFETCH = 200, 2000, 2000, 200, 4096
UNION_THRESHOLD, EXACT_SCAN_LIMIT = 100_000, 5000
#: Queries (with their features and vectors, a few kB each) that are scored in one pass; more take more passes.
QUERY_ROWS = 10_000
#: Digits kept before scores are compared, so that the order of summation can't decide a tie.
DIGITS = 9
TIES = ("path", "start_line", "chunk_id")


def filtered(chunks: DataFrame, model: str | None = None, repo: str | None = None, path_prefix: str | None = None, language: str | None = None) -> DataFrame:
    """Rows of a model, a repository (by id or path), a path prefix (case and wildcards as in LIKE) and a language;
    empty strings don't filter."""
    if model:
        chunks = chunks.filter(F.col("embedding_model") == model)
    if repo:
        chunks = chunks.filter((F.col("repo_id") == repo) | (F.col("repo_path") == repo))
    if path_prefix:
        pattern = path_prefix.replace("\\", "\\\\") + "%"
        chunks = chunks.filter(F.col("path").ilike(pattern))
    if language:
        chunks = chunks.filter(F.col("language") == language)
    return chunks


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf) over path, symbol and content, counted where each chunk lies: nothing is shuffled.

    Words are found by one expression in a worker, a third of the time that the compiled column expressions take.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scoring.slices(batches, 1024):
            fields = [batch.column(i).to_pylist() for i in (1, 2, 3)]
            words, counts, sizes = [], [], []
            for values in zip(*fields):
                found = Counter(t for v in values for t in text.token_list(v))
                words += found.keys()
                counts += found.values()
                sizes.append(len(found))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.record_batch([pa.array(words, pa.string()), batch.column(0).take(rows), pa.array(counts, pa.int64())], ["term", "chunk_id", "tf"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "path", "symbol_name", "content").mapInArrow(run, f"term string, chunk_id {kind}, tf long")


def doc_stats(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dl): number of tokens of each chunk; no shuffle."""
    return chunks.select("chunk_id", F.size(F.concat(*[text.tokens(c) for c in ("path", "symbol_name", "content")])).alias("dl"))


def term_stats(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame) -> list[str]:
    """All terms that the queries (a stated set) look up or compare, sorted."""
    words = F.concat(text.tokens("query_text"), text.query_terms("query_text"))
    return [r.term for r in queries.select(F.explode(words).alias("term")).distinct().orderBy("term").collect()]


def prepared(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """What scoring needs of each chunk, written as a table without contents; texts are tokenized once, in place.

    dl is the number of all tokens; in_content, in_path and in_symbol keep the tokens among `terms`, repeats included;
    in_plain_path are those of the path as the path list reads it, s_size the number of the symbol's distinct ones, found
    the count of each of the `terms` in the three fields together.
    """
    made = spread(chunks).withColumns(
        {
            "s_lower": F.lower(F.coalesce("symbol_name", F.lit(""))), "parser": F.coalesce(F.col("symbol_confidence") == "parser", F.lit(False)), "path_size": F.length("path"),
            "plain_times": paths.multiplier(F.lit(False), F.lit(False), "path"), "test_times": paths.multiplier(F.lit(False), F.lit(True), "path"), "_plain": F.translate(F.lower("path"), "/.-", "  _"),
        }
    )
    kept = [c for c in made.columns if c not in ("content", "_plain")]
    wanted = frozenset(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scoring.slices(batches):
            found = [[text.token_list(v) for v in batch.column(c).to_pylist()] for c in ("content", "path", "symbol_name", "_plain")]
            known = [[[t for t in words if t in wanted] for words in column] for column in found]
            lists = [pa.array(column, pa.list_(pa.string())) for column in known]
            counts = [Counter(a + b + c) for a, b, c in zip(*known[:3])]
            posted = pa.array([[{"term": t, "tf": n} for t, n in c.items()] for c in counts], pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())])))
            dl = pa.array([len(a) + len(b) + len(c) for a, b, c in zip(*found[:3])], pa.int32())
            s_size = pa.array([len(set(words)) for words in found[2]], pa.int32())
            yield pa.record_batch([*[batch.column(c) for c in kept], *lists, dl, s_size, posted], [*kept, "in_content", "in_path", "in_symbol", "in_plain_path", "dl", "s_size", "found"])

    schema = T.StructType([made.schema[c] for c in kept] + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("in_content", "in_path", "in_symbol", "in_plain_path")] + [T.StructField(c, T.IntegerType()) for c in ("dl", "s_size")])
    schema = schema.add("found", T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))
    return materialize(made.mapInArrow(run, schema), "prepared")


def bm25(queries: DataFrame, ready: DataFrame, limit: int | None = FTS_LIMIT, within: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, bm25, path, start_line, rank): best chunks by BM25.

    ready: (chunk_id, path, start_line, dl, found) of all chunks, or of those that hold any of the queries' terms with
    totals (n, tokens) of all: a prepared table or `from_postings`. Statistics are of all; within (chunk_id) restricts
    what may be found. A batch of chunks is a matrix of term weights, its product with the queries' terms the scores, and
    only its first `limit` rows of a query leave it. A greater score is better. Ties go by path, line and id.
    """
    totals = totals if totals is not None else ready.agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"))
    n, tokens = totals.select("n", "tokens").first()  # one row
    dfs = {r.term: r.n for r in ready.select(F.explode("found.term").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # the queries' terms
    rows = ready if within is None else ready.join(within.select("chunk_id"), "chunk_id", "left_semi")
    rows = rows.filter(F.size("found") > 0).select("chunk_id", "path", "start_line", "dl", "found")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("chunk_id", "start_line")}
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {kinds['chunk_id']}, bm25 double, path string, start_line {kinds['start_line']}"
    names = ["query_id", "chunk_id", "bm25", "path", "start_line"]
    average = (tokens or 0) / n if n else 1.0
    found = None
    for part in _passes(queries):
        asked = part.select("query_id", "query_text", text.query_terms("query_text").alias("fts")).orderBy("query_id").collect()  # one pass's queries
        number = {t: i for i, t in enumerate(sorted({t for r in asked for t in r.fts}))}
        raw = np.array([np.log((n - dfs.get(t, 0) + 0.5) / (dfs.get(t, 0) + 0.5)) for t in number])
        idf = np.where(raw <= 0, LEAST_IDF, raw)
        wanted = np.zeros((max(1, len(number)), len(asked)))
        for i, r in enumerate(asked):
            wanted[[number[t] for t in r.fts], i] = 1.0
        ids, keep = [r.query_id for r in asked], np.full(len(asked), 1 << 40 if limit is None else limit)

        def run(batches: Iterator[pa.RecordBatch], number: dict = number, idf: np.ndarray = idf, wanted: np.ndarray = wanted, ids: list = ids, keep: np.ndarray = keep) -> Iterator[pa.RecordBatch]:
            for batch in scoring.slices(batches):
                lists, flat = batch.column("found"), batch.column("found").flatten()
                row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
                term = np.array([number.get(t, -1) for t in flat.field("term").to_pylist()], np.int64)
                row, term, tf = row[term >= 0], term[term >= 0], np.asarray(flat.field("tf"), float)[term >= 0]
                dl = np.asarray(batch.column("dl"), float)[row]
                weight = np.zeros((batch.num_rows, len(wanted)))
                weight[row, term] = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))
                score = np.round(weight @ wanted, DIGITS)
                tie = scoring.fixed_order(batch, [("path", False), ("start_line", False), ("chunk_id", False)])
                yield from _emitted(batch, score, tie, weight @ wanted > 0, ids, keep, None, {"bm25": score}, ("path", "start_line"), names)

        some = rows.mapInArrow(run, schema)
        found = some if found is None else found.unionByName(some)
    return ranked(found, "bm25", limit)


def field_postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, in_content, in_path, in_symbol, in_plain_path): postings that also tell which fields hold the
    term, so that every score but the vector's can be had from them. in_plain_path is of the path as the path list reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scoring.slices(batches, 1024):
            columns = [batch.column(i).to_pylist() for i in (1, 2, 3, 4)]
            out: list[tuple] = []
            rows = []
            for i, values in enumerate(zip(*columns)):
                path, symbol, content, plain = (text.token_list(v) for v in values)
                counts = Counter(path + symbol + content)
                sets = [set(content), set(path), set(symbol), set(plain)]
                for term in counts.keys() | sets[3]:
                    out.append((term, counts.get(term, 0), *[term in s for s in sets]))
                    rows.append(i)
            cols = list(zip(*out)) or [()] * 6
            made = [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), *[pa.bool_()] * 4))]
            yield pa.record_batch([made[0], batch.column(0).take(pa.array(rows, pa.int64())), *made[1:]], ["term", "chunk_id", "tf", *FIELDS])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    plain = F.translate(F.lower("path"), "/.-", "  _").alias("plain")
    flags = ", ".join(f"{f} boolean" for f in FIELDS)
    return chunks.select("chunk_id", "path", "symbol_name", "content", plain).mapInArrow(run, f"term string, chunk_id {kind}, tf long, {flags}")


FIELDS = ("in_content", "in_path", "in_symbol", "in_plain_path")


def from_store(queries: DataFrame, posted: DataFrame, features: DataFrame) -> DataFrame:
    """What `prepared` gives, from stored field postings and stored features of chunks: no text is read again."""
    terms = query_terms(queries)
    asked = queries.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    used = posted.join(broadcast_if_small(asked, 20 * QUERY_ROWS), "term", "left_semi")
    lists = [F.collect_list(F.when(F.col(f), F.col("term"))).alias(f) for f in FIELDS]
    held = used.groupBy("chunk_id").agg(F.collect_list(F.when(F.col("tf") > 0, F.struct("term", "tf"))).alias("found"), *lists)
    ready = features.join(held, "chunk_id", "left")
    return materialize(ready.withColumns({c: F.coalesce(c, F.array().cast(ready.schema[c].dataType)) for c in ("found", *FIELDS)}), "ready")


def from_postings(queries: DataFrame, posted: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ready, totals) for `bm25` from stored postings (term, chunk_id, tf) and lengths (chunk_id, path, start_line, dl):
    only the postings of the queries' terms are read and grouped."""
    terms = broadcast_if_small(queries.select(F.explode(text.query_terms("query_text")).alias("term")).distinct(), 20 * QUERY_ROWS)
    used = posted.join(terms, "term", "left_semi").groupBy("chunk_id").agg(F.collect_list(F.struct("term", "tf")).alias("found"))
    return materialize(used.join(lengths, "chunk_id"), "found"), lengths.agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"))


def fts_score(value: Column | str) -> Column:
    """A BM25 value brought to [0, 1) as the full-text list's backend score."""
    value = F.abs(F.col(value) if isinstance(value, str) else value)
    return value / (1.0 + value)


def ranked(scores: DataFrame, score: str, limit: int | None, ascending: bool = False, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """With the rank of each row in its query, best first; at most `limit` rows of a query."""
    first = F.asc(score) if ascending else F.desc(score)
    order = Window.partitionBy(*keys).orderBy(first, *TIES)
    out = scores.withColumn("rank", F.row_number().over(order))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def minmax(scores: DataFrame, score: str, out: str, tied: float = 0.25) -> DataFrame:
    """Scores of each query brought to [0, 1]; a single row gets 1, rows that all tie get `tied`. For ranked lists, whose
    length is bounded: a query's rows lie together already."""
    of_query = Window.partitionBy("query_id")
    low, high, n = F.min(score).over(of_query), F.max(score).over(of_query), F.count("*").over(of_query)
    return scores.withColumn(out, F.when(n == 1, 1.0).when(high == low, tied).otherwise((F.col(score) - low) / (high - low)))


def knn(queries: DataFrame, items: DataFrame, limit: int, ties: tuple[str, ...], distance: str = "l2") -> DataFrame:
    """(query_id, further columns of queries and items, distance, rank): every query vector against every item.

    Queries are a stated set, held against a batch of items at a time; only a batch's first `limit` rows of a query leave it.
    """
    of_query = [c for c in queries.columns if c not in ("query_id", "query_vector")]
    of_item = [c for c in items.columns if c != "vector"]
    kinds = {c: df.schema[c].dataType.simpleString() for df, cs in ((queries, ["query_id"]), (items, of_item)) for c in cs}
    found = None
    for part in _passes(queries.select("query_id", "query_vector")):
        rows = [(r.query_id, r.query_vector) for r in part.filter("size(query_vector) > 0").collect()]  # at most about QUERY_ROWS
        ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], float)

        def run(batches: Iterator[pa.RecordBatch], ids: list = ids, x: np.ndarray = x) -> Iterator[pa.RecordBatch]:
            for batch in scoring.slices(batches):
                v = np.asarray(batch.column("vector").flatten()).reshape(batch.num_rows, -1)
                if distance == "l2":
                    # squared differences of the candidates are summed anew below: products alone would round
                    value = np.maximum((v * v).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2.0 * (v @ x.T), 0.0)
                else:
                    value = -scoring.cosines(batch.column("vector"), x)
                tie = scoring.fixed_order(batch, [(c, False) for c in ties])
                for i in range(len(ids)):
                    keep = min(limit, batch.num_rows)
                    edge = np.partition(value[:, i], keep - 1)[keep - 1]
                    at = np.flatnonzero(value[:, i] <= edge + 1e-7)
                    exact = np.sqrt(((v[at] - x[i]) ** 2).sum(axis=1)) if distance == "l2" else value[at, i]
                    exact = np.round(exact, DIGITS)
                    first = np.lexsort((tie[at], exact))[:keep]
                    rows_ = pa.array(at[first])
                    yield pa.record_batch([pa.array([ids[i]] * len(first)), pa.array(exact[first]), *[batch.column(c).take(rows_) for c in of_item]], ["query_id", "distance", *of_item])

        some = spread(items.filter(F.size("vector") > 0)).mapInArrow(run, f"query_id {kinds['query_id']}, distance double, " + ", ".join(f"{c} {kinds[c]}" for c in of_item))
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("query_id").orderBy("distance", *ties)
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return best.join(broadcast_if_small(queries.select("query_id", *of_query), QUERY_ROWS), "query_id") if of_query else best


def query_features(queries: DataFrame) -> DataFrame:
    return queries.withColumns(
        {
            "q_tokens": F.array_distinct(text.tokens("query_text")),
            "docs_query": paths.wants_docs("query_text"),
            "test_query": paths.wants_tests("query_text"),
        }
    )


def _passes(queries: DataFrame) -> list[DataFrame]:
    """The queries in as many parts as keep each near QUERY_ROWS."""
    parts = -(-queries.count() // QUERY_ROWS)
    if parts <= 1:
        return [queries]
    return [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == n) for n in range(parts)]


def _collected(queries: DataFrame, keep: str | int, terms: list[str], repos: str | None = None) -> scoring.Queries:
    """One pass's queries as arrays. keep: the column of how many rows each wants, or a number for all."""
    rows = query_features(queries).orderBy("query_id").collect()  # at most about QUERY_ROWS
    number = {t: i for i, t in enumerate(terms)}
    holds = np.zeros((len(rows), max(1, len(terms))), np.float32)
    for i, r in enumerate(rows):
        holds[i, [number[t] for t in r.q_tokens]] = 1.0
    vectors_ = np.array([r.query_vector for r in rows], float) if "query_vector" in queries.columns and rows else None
    wanted = np.array([(r[keep] or 0) if isinstance(keep, str) else keep for r in rows], np.int64)
    own = [(r[repos] or "") if repos else "" for r in rows]
    lower = [(r.query_text or "").lower() for r in rows]
    flags = [np.array([bool(r[c]) for r in rows], bool) for c in ("docs_query", "test_query")]
    return scoring.Queries([r.query_id for r in rows], number, holds, holds.sum(axis=1).astype(float), lower, vectors_, *flags, wanted, own)


def _with_queries(ready: DataFrame, values: DataFrame, q: scoring.Queries, column: str, value: str | None) -> DataFrame:
    """ready with a column of (query number, value) pairs, or of query numbers, of the rows of values (query_id, chunk_id)."""
    spark = ready.sparkSession
    kind = values.schema["query_id"].dataType.simpleString()
    numbers = spark.createDataFrame(list(zip(q.ids, range(len(q.ids)))), f"query_id {kind}, q int")  # none without queries
    pairs = values.join(F.broadcast(numbers), "query_id")  # one pass's queries
    entry = F.struct("q", F.col(value).alias("v")) if value else F.col("q")
    return ready.join(pairs.groupBy("chunk_id").agg(F.collect_list(entry).alias(column)), "chunk_id", "left")


def exact_list(source: str, queries: DataFrame, chunks: DataFrame, limit: int = EXACT_LIMIT, ready: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, source, backend_score, path, start_line, rank): the path, symbol or lexical list."""
    terms = query_terms(queries)
    ready = ready if ready is not None else prepared(chunks, terms)
    ready = ready.filter("symbol_name is not null and symbol_name <> '' and s_size > 0") if source == "symbol" else ready
    where = F.translate(F.lower("path"), "/. -", "____").alias("where")
    ready = ready.select("chunk_id", "path", "start_line", where, "in_content", "in_symbol", "in_plain_path", "s_size", "s_lower", "parser")
    kind = {c: ready.schema[c].dataType.simpleString() for c in ("chunk_id", "start_line")}
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {kind['chunk_id']}, backend_score double, path string, start_line {kind['start_line']}"
    found = None
    for part in _passes(queries):
        q = _collected(part, limit, terms)

        def run(batches: Iterator[pa.RecordBatch], q: scoring.Queries = q) -> Iterator[pa.RecordBatch]:
            asked = [x.strip(" ").replace(" ", "_") for x in q.lower]
            for batch in scoring.slices(batches):
                column = {n: batch.column(n) for n in batch.schema.names}
                if source == "path":
                    score = scoring.share(scoring.incidence(column["in_plain_path"], q.terms) @ q.holds.T.astype(float), q.sizes[None, :])
                    score = np.where(scoring.holds_query(column["where"].to_pylist(), asked), 2.0, score)
                elif source == "symbol":
                    held = scoring.incidence(column["in_symbol"], q.terms) @ q.holds.T.astype(float)
                    score = scoring.share(held, np.asarray(column["s_size"], float)[:, None])
                    score = np.where(scoring.names_symbol(column["s_lower"].to_pylist(), q.lower), 1.0, score) * (q.sizes > 0)[None, :]
                    score = score + 0.25 * (np.asarray(column["parser"])[:, None] & (score > 0))
                else:
                    score = scoring.share(scoring.incidence(column["in_content"], q.terms) @ q.holds.T.astype(float), q.sizes[None, :])
                score = np.round(score, DIGITS)
                tie = scoring.fixed_order(batch, [("path", False), ("start_line", False), ("chunk_id", False)])
                yield from _emitted(batch, score, tie, score > 0, q.ids, q.keep, None, {"backend_score": score}, ("path", "start_line"), schema_names)

        schema_names = ["query_id", "chunk_id", "backend_score", "path", "start_line"]
        some = ready.mapInArrow(run, schema)
        found = some if found is None else found.unionByName(some)
    return ranked(found, "backend_score", limit).withColumn("source", F.lit(source))


def _emitted(batch: pa.RecordBatch, score: np.ndarray, tie: np.ndarray, allowed: np.ndarray, ids: list, wanted: np.ndarray, files: np.ndarray | None, parts: dict[str, np.ndarray], columns: tuple[str, ...], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch that can be among the first of each query, with the parts of their scores."""
    if not len(wanted):
        return
    rows, which = [], []
    for i, keep in enumerate(wanted.tolist()):
        at = scoring.first_rows(score[:, i], tie, allowed[:, i], keep, files, 2)
        rows.append(at)
        which.append(np.full(len(at), i))
    row, number = np.concatenate(rows), np.concatenate(which)
    if not len(row):
        return
    take = pa.array(row)
    made = {"query_id": pa.array([ids[n] for n in number.tolist()]), "chunk_id": batch.column("chunk_id").take(take)}
    made |= {c: batch.column(c).take(take) for c in columns} | {c: pa.array(np.broadcast_to(v, score.shape)[row, number]) for c, v in parts.items()}
    yield pa.record_batch([made[n] for n in names], names)


#: Weights of the hybrid score's parts.
WEIGHTS = {"vector": 0.50, "lexical": 0.20, "bm25_score": 0.14, "symbol": 0.09, "path_score": 0.07}


def hybrid(queries: DataFrame, chunks: DataFrame, k: str | int, candidates: DataFrame | None = None, words: DataFrame | None = None, own_repo: str | None = None, ready: DataFrame | None = None, keep_all: bool = False) -> DataFrame:
    """(query_id, chunk_id, path, repo_id, start_line, symbol_confidence, docs_query, the parts, score): of every query
    and all its chunks those that can be among its first k after at most two of a file are preferred.

    queries hold query_vector, chunks vector; k: a column of queries or a number. words: (query_id, chunk_id, bm25_normal)
    of the chunks found by full text. candidates (query_id, chunk_id) restrict the pairs. own_repo: the column with the id
    or path of the repository a query is confined to. keep_all: every pair of a candidate set, for diagnosis.
    """
    terms = query_terms(queries)
    ready = ready if ready is not None else prepared(chunks, terms)
    ready = ready.filter(F.size("vector") > 0)
    chunk_kind = {c: ready.schema[c].dataType.simpleString() for c in ("chunk_id", "repo_id", "start_line")}
    names = ["query_id", "chunk_id", "repo_id", "path", "start_line", "symbol_confidence", "docs_query", *WEIGHTS, "multiplier", "score"]
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), **chunk_kind, "path": "string", "symbol_confidence": "string", "docs_query": "boolean"}
    schema = ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names)
    found = None
    for part in _passes(queries):
        q = _collected(part, 1 << 40 if keep_all else k, terms, own_repo)
        rows = ready
        if words is not None:
            rows = _with_queries(rows, words.select("query_id", "chunk_id", "bm25_normal"), q, "_words", "bm25_normal")
        if candidates is not None:
            rows = _with_queries(rows, candidates.select("query_id", "chunk_id").distinct(), q, "_asked", None).filter("_asked is not null")

        def run(batches: Iterator[pa.RecordBatch], q: scoring.Queries = q) -> Iterator[pa.RecordBatch]:
            holds = q.holds.T.astype(float)
            for batch in scoring.slices(batches if q.ids else iter(())):
                column = {n: batch.column(n) for n in batch.schema.names}
                shape = (batch.num_rows, len(q.ids))
                size = q.sizes[None, :]
                parts = {"vector": np.clip((scoring.cosines(column["vector"], q.vectors) + 1.0) / 2.0, 0.0, 1.0)}
                parts["lexical"] = scoring.share(scoring.incidence(column["in_content"], q.terms) @ holds, size)
                parts["bm25_score"] = scoring.pair_values(column["_words"], len(q.ids), "v") if "_words" in column else np.zeros(shape)
                s_size = np.asarray(column["s_size"], float)[:, None]
                symbol = scoring.share(scoring.incidence(column["in_symbol"], q.terms) @ holds, s_size)
                named = scoring.names_symbol(column["s_lower"].to_pylist(), q.lower)
                parts["symbol"] = np.where(named, 1.0, symbol) * ((s_size > 0) & (size > 0))
                parts["path_score"] = scoring.share(scoring.incidence(column["in_path"], q.terms) @ holds, size)
                base = np.zeros(shape)
                for name, weight in WEIGHTS.items():
                    base = base + weight * parts[name]
                times = np.where(q.tests[None, :], np.asarray(column["test_times"])[:, None], np.asarray(column["plain_times"])[:, None])
                times = np.where(q.docs[None, :], 1.0, times)
                score = np.round(base * times, DIGITS)
                allowed = scoring.pair_values(column["_asked"], len(q.ids), None) > 0 if "_asked" in column else np.ones(shape, bool)
                if any(q.repos):
                    ids, places = np.array(column["repo_id"].to_pylist(), object)[:, None], np.array(column["repo_path"].to_pylist(), object)[:, None]
                    own = np.array(q.repos, object)[None, :]
                    allowed = allowed & ((own == "") | (ids == own) | (places == own))
                tie = scoring.fixed_order(batch, [("parser", True), ("path_size", False), ("start_line", False), ("chunk_id", False)])
                file = pa.compute.binary_join_element_wise(column["repo_id"].cast("string"), column["path"], "\0").dictionary_encode()
                files = np.asarray(file.indices.fill_null(-1))
                extra = {**parts, "multiplier": times, "score": score, "docs_query": q.docs[None, :]}
                yield from _emitted(batch, score, tie, allowed, q.ids, q.keep, files, extra, ("repo_id", "path", "start_line", "symbol_confidence"), names)

        wanted = ["chunk_id", "repo_id", "repo_path", "path", "start_line", "symbol_confidence", "parser", "path_size", "s_size", "s_lower", "in_content", "in_path", "in_symbol", "plain_times", "test_times", "vector"]
        some = rows.select(*wanted, *[c for c in ("_words", "_asked") if c in rows.columns]).mapInArrow(run, schema)
        found = some if found is None else found.unionByName(some)
    return found


def result_order() -> list[Column]:
    parser = F.when(F.col("symbol_confidence") == "parser", 1).otherwise(0)
    return [F.desc("score"), F.desc(parser), F.length("path"), F.col("start_line"), F.col("chunk_id")]


def diversified(results: DataFrame, k: Column, per_file: int = 2, order: list[Column] | None = None, bypass: Column | None = None) -> DataFrame:
    """The first k of each query, chunks of a file beyond `per_file` after all others; `bypass` rows keep plain order."""
    order = order or result_order()
    first = results.withColumn("_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    within = F.row_number().over(Window.partitionBy("query_id", "repo_id", "path").orderBy("_rank"))
    late = within > per_file
    if bypass is not None:
        late = late & ~F.coalesce(bypass, F.lit(False))
    placed = first.withColumn("_late", late.cast("int"))
    final = F.row_number().over(Window.partitionBy("query_id").orderBy("_late", "_rank"))
    return placed.withColumn("position", final).filter(F.col("position") <= k).drop("_rank", "_late")


def rrf(lists: DataFrame, bonus: bool = False, keep: int | None = None) -> DataFrame:
    """(query_id, chunk_id, rrf_score, best_rank, sources, source_ranks, path, start_line, rank) of ranked lists
    (query_id, source, chunk_id, rank, path, start_line)."""
    fused = lists.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("total"),
        F.min("rank").alias("best_rank"),
        F.count("*").alias("sources"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "rank")))).alias("source_ranks"),
        F.min_by("path", F.struct("source", "rank")).alias("path"),
        F.min_by("start_line", F.struct("source", "rank")).alias("start_line"),
    )
    extra = F.when(F.col("best_rank") == 1, TOP_BONUS).when(F.col("best_rank") <= 3, NEAR_BONUS).otherwise(0.0) if bonus else F.lit(0.0)
    fused = fused.withColumn("rrf_score", F.round(F.col("total") + extra, DIGITS)).drop("total")
    return ranked(fused, "rrf_score", keep)


def union_plan(queries: DataFrame, near: DataFrame, words: DataFrame, k: str, total_chunks: int, covered: bool, threshold: int = UNION_THRESHOLD) -> DataFrame:
    """(query_id, by_union): whether a query is answered from the union of its candidates instead of all chunks.

    It is tried for queries that don't ask for documents, over an index of at least `threshold` chunks that all have
    vectors; it holds if there are near vectors, and with full-text candidates the union is at least ten times k (50 at
    least), without them the vectors alone make up k. near, words: (query_id, chunk_id).
    """
    v, f = near.select("query_id", "chunk_id").distinct(), words.select("query_id", "chunk_id").distinct()
    both = v.withColumn("v", F.lit(1)).join(f.withColumn("f", F.lit(1)), ["query_id", "chunk_id"], "full_outer")
    sizes = both.groupBy("query_id").agg(F.count("v").alias("nv"), F.count("f").alias("nf"), F.count("*").alias("n"))
    rows = query_features(queries).select("query_id", F.col(k).alias("k"), "docs_query").join(sizes, "query_id", "left").fillna(0, ["nv", "nf", "n"])
    tried = F.lit(covered and total_chunks >= threshold) & F.col("k").isNotNull() & ~F.col("docs_query")
    enough = F.when(F.col("nf") == 0, F.col("nv") >= F.col("k")).otherwise(F.col("n") >= F.greatest(F.lit(50), 10 * F.col("k")))
    return rows.select("query_id", F.coalesce(tried & (F.col("nv") > 0) & enough, F.lit(False)).alias("by_union"))


def rrf_search(queries: DataFrame, chunks: DataFrame, k: str, words: DataFrame, near: DataFrame, exact: DataFrame | None = None, bonus: bool = False, covered: bool = True, has_vectors: bool = True) -> tuple[DataFrame, DataFrame]:
    """(results, reasons): fused rankings of the queries, and for each query why it has none (null if it has).

    words and near are ranked lists (query_id, chunk_id, rank, path, start_line), exact further ones with their source.
    Of each query the first 4 k fused rows (50 at least, 500 at most) are kept, and the first k after diversifying given;
    a query that asks for documents keeps plain order.
    """
    lists = words.withColumn("source", F.lit("fts")).select("query_id", "chunk_id", "source", "rank", "path", "start_line")
    lists = lists.unionByName(near.withColumn("source", F.lit("vector")).select(*lists.columns))
    if exact is not None:
        lists = lists.unionByName(exact.select(*lists.columns))
    has = lambda df, c: df.select("query_id").distinct().withColumn(c, F.lit(True))
    asked = query_features(queries).select("query_id", F.col(k).alias("k"), "docs_query").join(has(words, "f"), "query_id", "left").join(has(near, "v"), "query_id", "left")
    reason = F.when(F.col("k").isNull(), "k_none").when(F.col("f").isNull(), "no_fts_candidates")
    if not has_vectors:
        reason = reason.otherwise("vector_table_missing")
    elif not covered:
        reason = reason.otherwise("vector_coverage_incomplete")
    else:
        reason = reason.when(F.col("v").isNull(), "no_vector_candidates")
    asked = asked.select("query_id", "k", "docs_query", reason.alias("reason"))
    able = asked.filter("reason is null").drop("reason")
    fused = rrf(lists.join(F.broadcast(able.select("query_id")), "query_id", "left_semi"), bonus=bonus, keep=500).join(F.broadcast(able), "query_id")  # the queries, a stated set
    fused = fused.filter(F.col("rank") <= F.least(F.lit(500), F.greatest(F.lit(50), 4 * F.col("k"))))
    rows = fused.drop("path", "start_line").join(chunks.select("chunk_id", "repo_id", "path", "start_line"), "chunk_id")
    return diversified(rows, F.col("k"), order=[F.col("rank")], bypass=F.col("docs_query")), asked.select("query_id", "reason")


def symbol_lookup(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """(name, chunk_id, symbol_name, path, start_line): for each name the best symbol, exact before part, parser before
    others, short before long; an empty name is part of every symbol."""
    c = chunks.filter("symbol_name is not null and symbol_name <> ''").select("chunk_id", "symbol_name", "symbol_confidence", "path", "start_line")
    wanted = names.select("name").distinct()
    exact = c.join(wanted, F.lower("symbol_name") == F.lower("name"))
    # only names that no symbol equals are held against every distinct symbol
    rest = wanted.join(c.select(F.lower("symbol_name").alias("known")).distinct(), F.lower("name") == F.col("known"), "left_anti")
    holders = c.select("symbol_name").distinct().join(broadcast_if_small(rest, QUERY_ROWS), F.contains(F.lower("symbol_name"), F.lower("name")))
    pairs = exact.unionByName(c.join(holders, "symbol_name"))
    order = [F.when(F.lower("symbol_name") == F.lower("name"), 0).otherwise(1), F.when(F.col("symbol_confidence") == "parser", 0).otherwise(1), F.length("symbol_name"), F.col("chunk_id")]
    best = pairs.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy(*order))).filter("n = 1")
    return best.select("name", "chunk_id", "symbol_name", "path", "start_line", F.lit(1.0).alias("score"))
