"""Encoding of a text column by a public byte-level BPE vocabulary through a transducer lexicon of frequent words.

Three steps, each over all rows: count the words of the corpus (combined per partition before the shuffle), compile the
most frequent ones with their ids into a minimal acyclic transducer (one file in the shared folder, memory-mapped by
every worker), then encode: words of the lexicon by walking it, the rest by exact merges. The lexicon's size is a
parameter and bounds what the driver sees; it changes the speed only, never a result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import create_file, materialize, shared_dir, tracked
from . import lexicon as lx

#: Words compiled into the lexicon, and the longest word taken (bytes): 65,536 x 64 B = 4 MB at most at the driver, of
#: the whole input together.
LEXICON_WORDS, LEXICON_BYTES = 65_536, 64
#: Characters handled at once in a worker; a longer text is handled alone and whole.
BATCH_CHARS = 1_000_000
#: Distinct words kept in a worker before its counts are passed on.
COUNT_FLUSH = 300_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """Nulls become empty texts; slices hold about BATCH_CHARS characters."""
    out: list[str] = []
    n = 0
    for text in texts.to_pylist():
        out.append(text or "")
        n += len(out[-1])
        if n >= BATCH_CHARS:
            yield out
            out, n = [], 0
    if out:
        yield out


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, n long) of a frame whose only column is the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in _slices(batch.column(0)):
                buf, begin, size, _ = lx.split_words(part)
                _, first, n = np.unique(lx.hash_words(buf, begin, size), return_index=True, return_counts=True)
                raw = buf.tobytes()
                for b, s, k in zip(begin[first].tolist(), size[first].tolist(), n.tolist()):
                    counts[raw[b : b + s]] += k
                if len(counts) > COUNT_FLUSH:
                    yield pa.record_batch([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
                    counts = Counter()
        yield pa.record_batch([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, words: int) -> list[bytes]:
    """The words above the least count that at most `words` words reach, to an eighth of a power of two.

    counts: (word, n), written. Only a histogram of at most 512 rows and then those words come to the driver, from all
    partitions together: no partition sends a list of its own.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    histogram = {r.level: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}
    taken, least = 0, None
    for at in sorted(histogram, reverse=True):
        taken += histogram[at]
        if taken > words:
            break
        least = at
    return [] if least is None else [bytes(r.word) for r in counts.filter(level >= least).select("word").collect()]


def build_lexicon(texts: DataFrame, ranks: str, words: int = LEXICON_WORDS) -> str:
    """Count, choose, compile and write; returns the name under which every worker finds the file.

    The lexicon is one file in the shared folder, and Spark gives each executor a copy in its own work folder, also to
    those that join later; workers map that copy. Words that occur once aren't worth a place in it.
    """
    spark = texts.sparkSession
    counts = materialize(count_words(texts).filter((F.col("n") > 1) & F.length("word").between(1, LEXICON_BYTES)), "words")
    chosen = frequent_words(counts, words)
    merge = lx.merger(ranks)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = tracked(spark, f"{shared_dir(spark)}/lodeseam/{name}")
    create_file(spark, path, lx.pack_lexicon(chosen, [merge(w) for w in chosen]))
    spark.sparkContext.addFile(path)
    return name


def encode(df: DataFrame, key: str, text: str, ranks: str | None = None, ids: bool = True, words: int = LEXICON_WORDS) -> DataFrame:
    """(key, ids array<int>) of every row of df, or (key, n_tokens int) if not ids.

    Null and empty texts give an empty list (0 tokens); text that looks like a special token is plain text; repeated
    rows are each encoded; an empty table gives an empty result. Other columns of df, whatever their names, are ignored.
    """
    ranks = ranks or default_ranks()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    place = build_lexicon(rows.select("text").filter(F.length("text") > 0), ranks, words)
    kind = rows.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False) if ids else T.StructField("n_tokens", T.IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, merge = lx.open_lexicon(SparkFiles.get(place)), lx.merger(ranks)
        for batch in batches:
            at = 0
            for part in _slices(batch.column(1)):
                flat, n = lx.encode_texts(part, lex, merge)
                keys = batch.column(0).slice(at, len(part))
                at += len(part)
                if ids:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                    yield pa.record_batch([keys, pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))], ["key", "ids"])
                else:
                    yield pa.record_batch([keys, pa.array(n.astype(np.int32))], ["key", "n_tokens"])

    out = rows.mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)
