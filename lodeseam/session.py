"""Session settings, the shared folder, written intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings for local runs and tests. On a cluster the submitter's own settings win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

#: Rows of a key set that may be broadcast (ids of 8 bytes: 16 MB at most).
BROADCAST_ROWS = 2_000_000


def build_session(app: str = "lodeseam", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local master (tests) gets a folder of
    its own; on a cluster it is an error, as executors would each write to their own disk."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = getattr(spark.sparkContext, "_lodeseam_dir", None)
        if not known:
            known = "file://" + tempfile.mkdtemp(prefix="lodeseam-")
            spark.sparkContext._lodeseam_dir = known
            spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _delete(spark: SparkSession, path: str) -> None:
    try:
        files, target = _hadoop(spark, path)
        files.delete(target, True)
    except Exception:  # the JVM is gone: the folder's owner clears it
        pass


def create_file(spark: SparkSession, path: str, data: bytes) -> bool:
    """Write a file that isn't there yet, whole and at once; False if it is there already. Of several that try, one wins.

    The data go into a file of their own, which then takes the name only if it is free: by a link on a local disk, by a
    rename that doesn't overwrite elsewhere (atomic on HDFS and its like).
    """
    files, target = _hadoop(spark, path)
    part = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    out = files.create(_hadoop(spark, part)[1])
    out.write(bytearray(data))
    out.close()
    try:
        if files.getScheme() == "file":
            os.link(_local(part), _local(path))
            return True
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        none[0] = hadoop.Options.Rename.NONE
        hadoop.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(_hadoop(spark, part)[1], target, none)
        return True
    except FileExistsError:
        return False
    except Exception:
        if files.exists(target):
            return False
        raise
    finally:
        _delete(spark, part)


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def read_file(spark: SparkSession, path: str) -> bytes | None:
    """A small file whole; None if it isn't there."""
    files, target = _hadoop(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def release(spark: SparkSession) -> None:
    """Delete what `materialize` has written so far; frames that read it must no longer be used."""
    for path in _WRITTEN:
        _delete(spark, path)
    _WRITTEN.clear()


_WRITTEN: list[str] = []


def tracked(spark: SparkSession, path: str) -> str:
    """path, to be deleted by `release` or at the interpreter's end."""
    if not _WRITTEN:
        atexit.register(release, spark)
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Cut the lineage by writing df into the shared folder; what is read back survives the loss of an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodeseam/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    tracked(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, hinted for broadcast only if it is counted to hold at most `rows` rows; else the shuffle join stays.

    df should be a written table of narrow rows, as it is counted here and read again by the join.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """df shuffled by the keys into a stated number of partitions, several for each core: work in Python on what follows
    isn't packed into a few tasks because its rows are small."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def spread(df: DataFrame, bytes_each: int = 64 << 20) -> DataFrame:
    """df over all cores where the optimizer's estimate of its size gives fewer partitions than cores (a small table
    before costly rows); large tables stay as they are. Nothing is run to find out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * bytes_each else df
