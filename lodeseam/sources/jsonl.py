"""Line-wise JSON: usage events with a count of bad lines, golden cases, appended events."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.usage import SCHEMA


def parse_lines(lines: DataFrame, schema: str, line: str = "value") -> DataFrame:
    """lines with `parsed` (null for a bad line) and `is_bad`; blank lines are no lines. An object is wanted: arrays,
    numbers and broken text are bad."""
    kept = lines.filter(F.trim(line) != "")
    good = F.try_parse_json(line).isNotNull() & F.trim(line).startswith("{")
    parsed = F.when(good, F.from_json(line, schema, {"mode": "PERMISSIVE"}))
    return kept.withColumn("is_bad", ~good).withColumn("parsed", parsed)


def read_events(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(events with line_no, one row with bad_line_count); files that aren't there are left out."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = [p for p in paths if make(p).getFileSystem(hadoop).exists(make(p))]
    lines = spark.read.text(there) if there else spark.createDataFrame([], "value string")
    rows = parse_lines(lines.withColumn("line_no", F.monotonically_increasing_id()), SCHEMA)
    events = rows.filter("not is_bad").select("line_no", "parsed.*")
    return events, rows.agg(F.count_if("is_bad").alias("bad_line_count"))


CASE_FIELDS = ("id", "query", "expected_path", "expected_text", "expected_symbol", "notes", "repo_url", "repo_ref", "query_type")


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an evaluation; blank lines and those that begin with # are left out. A line that is no object, or has a
    field that isn't known, is an error with its number."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "value"))
    lines = lines.filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    known = F.array(*map(F.lit, CASE_FIELDS))
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    wrong = F.when(F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{"), "no object").when(F.size(F.array_except(keys, known)) > 0, F.concat(F.lit("unknown field "), F.array_join(F.array_except(keys, known), ", ")))
    bad = lines.select((F.col("at") + 1).alias("line"), wrong.alias("wrong")).filter("wrong is not null").orderBy("line").first()
    if bad:
        raise ValueError(f"{path}, line {bad.line}: {bad.wrong}")
    return lines.select(F.from_json("value", ", ".join(f"{c} string" for c in CASE_FIELDS)).alias("case")).select("case.*")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def append_line(path: str, event: dict, strict: bool = False) -> bool:
    """One event at the end of a local log that only its owner may read, keys in order. Unless strict, a failure is no
    error; with LODESEAM_USAGE_LOG=0 nothing is written."""
    if os.environ.get("LODESEAM_USAGE_LOG") == "0":
        return False
    try:
        os.makedirs(os.path.dirname(os.path.abspath(path)), mode=0o700, exist_ok=True)
        handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o600)
        with os.fdopen(handle, "a", encoding="utf-8") as f:
            f.write(json.dumps(event, sort_keys=True) + "\n")
        return True
    except OSError:
        if strict:
            raise
        return False


def add_case(path: str, case: dict, looks_secret) -> None:
    """Append a case to an evaluation; one whose query, text, symbol or notes hold what looks like a secret is refused."""
    for field in ("query", "expected_text", "expected_symbol", "notes"):
        if case.get(field) and looks_secret(case[field]):
            raise ValueError(f"{field} looks like a secret")
    if unknown := sorted(set(case) - set(CASE_FIELDS)):
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    append_line(path, {k: v for k, v in case.items() if v is not None}, strict=True)
