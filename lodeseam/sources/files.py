"""Plain files as a table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .git import LARGEST


def text_files(spark: SparkSession, root: str, largest: int = LARGEST) -> DataFrame:
    """(path, content, content_hash) of files under root that are neither large nor binary nor of another encoding;
    the size is compared before anything is read."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("length") <= largest)
    plain = files.filter(F.locate("\0", F.decode(F.substring("content", 1, 4096), "ISO-8859-1")) == 0).filter(F.is_valid_utf8("content"))
    text = F.decode("content", "UTF-8")
    relative = F.element_at(F.split("path", f"\\Q{base.removeprefix('file://')}\\E", 2), -1)
    return plain.select(relative.alias("path"), text.alias("content"), F.sha2("content", 256).alias("content_hash"))
