"""Continuous ingest: a stream of file versions becomes a log of chunk versions, read merged.

Every micro-batch replaces the folder named by its number, so a batch that is run again after a failure leaves the same
log. Nothing already written is rewritten: readers take the newest version of each file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunker import chunk_files, chunk_id, indexable


def write_log(stream: DataFrame, folder: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Each micro-batch, transformed, into folder/batch=N; `once` processes what is there and stops."""

    def batch(rows: DataFrame, number: int) -> None:
        transform(rows).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def chunk_versions(files: DataFrame) -> DataFrame:
    """Chunks of file versions (repo_id, repo_path, path, content, indexed_at); null content is a removed file, kept as a
    row without content so that it hides older versions."""
    newest = F.row_number().over(Window.partitionBy("repo_id", "path").orderBy(F.desc("indexed_at")))
    last = files.withColumn("n", newest).filter("n = 1").drop("n")
    times = last.select("repo_id", "path", "indexed_at")
    made = chunk_files(last.filter("content is not null")).filter(indexable()).withColumn("chunk_id", chunk_id())
    gone = last.filter("content is null").select("repo_id", "repo_path", "path")
    return made.unionByName(gone, allowMissingColumns=True).join(times, ["repo_id", "path"])


def current(log: DataFrame) -> DataFrame:
    """The chunks of each file's newest version; files whose newest version is a removal have none."""
    newest = F.max("indexed_at").over(Window.partitionBy("repo_id", "path"))
    return log.withColumn("newest", newest).filter("indexed_at = newest and content is not null").drop("newest")


def ingest(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Files that arrive as parquet under source, chunked into the log under folder."""
    stream = spark.readStream.schema(schema).parquet(source)
    return write_log(stream, folder, checkpoint, chunk_versions, once)


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per key and time window; windows close when the watermark passes them."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
