"""The queries of the training-data problems, over the whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shared_dir, table, tracked
from . import mixing, neighbours, provenance, rankwalk, secrets, spans, splitting, syntax, tokens
from .files import LANGUAGES, current_files


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "ranked_candidates").select("query_id", F.col("source").alias("list"), F.col("chunk_rowid").alias("item"), F.col("backend_score").alias("score"))
    results = table(spark, sf_dir, "search_results").select("query_id", F.concat(F.lit("results:"), "ranking_mode").alias("list"), F.col("chunk_rowid").alias("item"), "score")
    return candidates.unionByName(results)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = rankwalk.rank(_lists(spark, sf_dir))
    return rankwalk.top_k(weights, table(spark, sf_dir, "search_queries")).select("query_id", F.col("item").alias("chunk_rowid"))


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankwalk.rank(_lists(spark, sf_dir)).select("query_id", F.col("item").alias("chunk_rowid"), F.round("weight", 9).alias("weight"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "chunks"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redact(table(spark, sf_dir, "chunks"))


def p2_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.candidates(secrets.stored_index(table(spark, sf_dir, "chunks")))


def _files(spark: SparkSession, sf_dir: str, suffixes: list[str] | None = None) -> DataFrame:
    return materialize(current_files(table(spark, sf_dir, "chunks"), suffixes), "files")


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.find(_files(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_kinds(spark, sf_dir).select("repo_id", "path")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select(F.col("chunk_rowid").alias("id"), F.col("embedding_model").alias("model"), F.col("embedding").alias("vector"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.expand(*neighbours.similar_pairs(_vectors(spark, sf_dir))).select(F.col("a").alias("rowid_a"), F.col("b").alias("rowid_b"))


def p4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return neighbours.top_k(vectors, vectors.filter("id % 50 = 0").select("id")).withColumnsRenamed({"id": "chunk_rowid", "neighbour": "neighbour_rowid"})


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read once, so the files go from their shuffle straight into the parsers, in its partitions
    return syntax.check(current_files(table(spark, sf_dir, "chunks"), list(LANGUAGES)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_files(spark, sf_dir).filter("not parses").select("repo_id", "path")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.rates(p5_files(spark, sf_dir))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks")
    pieces = splitting.split_texts(chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("text")))
    at = chunks.select("chunk_id", "path", "start_line").filter(F.octet_length("content") > splitting.Plan().limit).dropDuplicates(["chunk_id"])
    rows = pieces.join(at, pieces["id"] == at["chunk_id"])
    base = F.coalesce("start_line", F.lit(1))
    return rows.select("chunk_id", "path", "piece_no", "start_byte", "end_byte", (base + F.col("first_line")).alias("start_line"), (base + F.col("last_line")).alias("end_line"), "boundary", F.col("text").alias("content"))


def p6_file_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contents as text files in the shared folder, each split by ranges: no worker reads more of a file than its own."""
    folder = tracked(spark, f"{shared_dir(spark)}/lodeseam/texts-{uuid.uuid4().hex}")
    table(spark, sf_dir, "chunks").filter("content is not null").select("content").write.text(folder)
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path")  # names only: contents aren't read
    pieces = splitting.split_files(paths)
    return pieces.select(F.regexp_extract("id", "part-[0-9]+", 0).alias("file"), "piece_no", "start_byte", "end_byte", "first_line", "last_line", "boundary", F.octet_length("text").alias("n_bytes"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pieces(spark, sf_dir).select("chunk_id").distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, size in tokens) of every document; ids are unique."""
    docs = table(spark, sf_dir, "documents")
    sizes = materialize(tokens.encode(docs, "doc_id", "text", ids=False), "sizes")
    return docs.select("doc_id", "source").join(sizes, "doc_id").withColumnRenamed("n_tokens", "size")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = materialize(_sizes(spark, sf_dir), "sized")
    rates = materialize(mixing.source_rates(sizes, table(spark, sf_dir, "mix_targets")), "rates")
    return mixing.mix(sizes, rates), rates


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0].repartitionByRange("position").sortWithinPartitions("position")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_shares(spark, sf_dir).filter("falls_short").select("source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.document_pairs(spans.shared_spans(table(spark, sf_dir, "documents")))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spans.shared_fraction(docs, spans.shared_spans(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_ranking, p2_found, p2_redacted, p2_candidates, p3_found, p3_kinds, p4_found, p4_topk, p5_found, p5_files, p5_rates, p6_found, p6_pieces, p6_file_pieces, p8_ids, p9_found, p9_mix, p9_shares, p10_found, p10_shared)}
ORACLES: dict[str, str] = {
    "p4_found": "WITH u AS (SELECT DISTINCT chunk_rowid, embedding_model, CASE WHEN len(embedding) = 64 AND list_count(embedding) = 64 THEN embedding END AS e FROM chunks WHERE embedding_model IS NOT NULL), v AS (SELECT chunk_rowid, embedding_model, e, sqrt(list_dot_product(e, e)) AS n FROM u WHERE e IS NOT NULL), w AS MATERIALIZED (SELECT * FROM v WHERE n > 0) SELECT a.chunk_rowid AS rowid_a, b.chunk_rowid AS rowid_b FROM w a JOIN w b ON a.embedding_model = b.embedding_model AND a.chunk_rowid < b.chunk_rowid WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9",
    "p6_found": "SELECT DISTINCT chunk_id FROM chunks WHERE strlen(content) > 6000",
    "p10_found": "WITH w AS (SELECT DISTINCT doc_id, md5(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id",
}
