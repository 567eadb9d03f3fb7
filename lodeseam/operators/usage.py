"""Reports over a log of usage events: one row of metrics, latest state per key, duplicates, a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources of a baseline that count, and the checks an activation must have passed.
BASELINE_SOURCES = ["observed_paired_task", "prior_comparable"]
ACTIVATION_CHECKS = ["doctor_ok", "repo_indexed", "tools_visible", "list_repos_ok", "search_code_ok", "relevant_result"]

SCHEMA = """ts string, event string, engineer string, task_id string, week2 boolean, enabled boolean, decision_grade boolean, useful string,
baseline_source string, baseline_minutes string, tool_minutes string, baseline_files_pasted string, tool_files_pasted string, mcp_queries string,
latency_ms string, result_count string, raw_query_length string, scrubbed_query string, expected_path string, expected_text_length string,
doctor_ok boolean, repo_indexed boolean, tools_visible boolean, list_repos_ok boolean, search_code_ok boolean, relevant_result boolean"""


def latest(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value): the value of each key's last row by the order columns; combined before the shuffle."""
    return events.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def duplicates(events: DataFrame, key: str) -> DataFrame:
    """(key, extra): keys that occur more than once and how many rows too many they have."""
    return events.groupBy(key).agg((F.count("*") - 1).alias("extra")).filter("extra > 0")


def counts_with_zero(keys: DataFrame, events: DataFrame, key: str) -> DataFrame:
    return keys.select(key).distinct().join(events.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def number(c: str) -> Column:
    return F.col(c).try_cast("double")


def decision_grade() -> Column:
    """Whether a finished task may decide: a known baseline source, answers, a positive baseline, no negative count."""
    ok = F.col("baseline_source").isin(BASELINE_SOURCES) & F.col("useful").isNotNull() & F.col("mcp_queries").isNotNull()
    ok = ok & F.coalesce(number("baseline_minutes") > 0, F.lit(False)) & F.coalesce(number("tool_minutes") >= 0, F.lit(False))
    for c in ("baseline_files_pasted", "tool_files_pasted", "mcp_queries"):
        ok = ok & (F.col(c).isNull() | F.coalesce(F.col(c).try_cast("long") >= 0, F.lit(False)))
    return ok


def valid_tasks(events: DataFrame) -> DataFrame:
    """Finished tasks that decide: begun, finished once, and valid."""
    graded = events.filter((F.col("event") == "task_end") & F.coalesce("decision_grade", F.lit(False)))
    once = graded.groupBy("task_id").agg(F.count("*").alias("n")).filter("n = 1").select("task_id")
    begun = events.filter("event = 'task_start'").select("task_id").distinct()
    return graded.filter(decision_grade()).join(once, "task_id", "left_semi").join(begun, "task_id", "left_semi")


def reduction(before: str, after: str) -> Column:
    return F.try_divide(number(before) - number(after), number(before))


def report(events: DataFrame) -> DataFrame:
    """One row of pilot metrics over parsed events (SCHEMA plus line_no)."""
    activated = events.filter("event = 'activation' and engineer is not null").filter(" and ".join(f"coalesce({c}, false)" for c in ACTIVATION_CHECKS)).select("engineer").distinct()
    tasks = valid_tasks(events)
    retained = latest(events.filter("event = 'retention' and coalesce(week2, false)").filter(number("ts").isNotNull()).withColumn("at", number("ts")), "engineer", "enabled", ["at", "line_no"])
    kept = retained.filter("enabled").join(activated, "engineer", "left_semi")
    graded = events.filter("event = 'task_end' and coalesce(decision_grade, false)")
    per_engineer = counts_with_zero(activated, tasks, "engineer")
    basic = events.agg(
        F.count("*").alias("events"),
        F.count_if(F.col("event") == "search").alias("search_count"),
        F.try_divide(F.count_if((F.col("event") == "search") & (number("result_count") == 0)), F.count_if(F.col("event") == "search")).alias("zero_result_rate"),
        F.median(F.when(F.col("event") == "search", number("latency_ms"))).alias("median_query_latency_ms"),
        F.count_if(F.col("event") == "task_end").alias("completed_tasks"),
        F.count_if(F.col("event") == "miss").alias("miss_count"),
    )
    of_tasks = tasks.agg(
        F.count("*").alias("valid_decision_grade_tasks"),
        F.median(number("baseline_minutes")).alias("median_baseline_minutes"),
        F.median(number("tool_minutes")).alias("median_tool_minutes"),
        F.median(number("baseline_files_pasted")).alias("median_baseline_files_pasted"),
        F.median(number("tool_files_pasted")).alias("median_tool_files_pasted"),
        F.median(reduction("baseline_minutes", "tool_minutes")).alias("context_minutes_reduction"),
        F.median(reduction("baseline_files_pasted", "tool_files_pasted")).alias("file_paste_reduction"),
    )
    rest = [
        activated.agg(F.count("*").alias("activation_count")),
        kept.agg(F.count("*").alias("retained")),
        graded.agg(F.count("*").alias("decision_grade_tasks")),
        duplicates(graded, "task_id").agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_task_end_count")),
        per_engineer.agg(F.coalesce(F.min("n"), F.lit(0)).alias("least_tasks")),
    ]
    row = basic.crossJoin(of_tasks)  # single rows
    for r in rest:
        row = row.crossJoin(r)
    row = row.withColumn("week2_retention_rate", F.try_divide("retained", "activation_count"))
    return row.withColumns(gate())


def tasks_by_engineer(events: DataFrame) -> DataFrame:
    """(engineer_id, n): valid tasks of each activated engineer, zeros included, under a hash of the name."""
    activated = events.filter("event = 'activation' and engineer is not null").filter(" and ".join(f"coalesce({c}, false)" for c in ACTIVATION_CHECKS))
    return counts_with_zero(activated, valid_tasks(events), "engineer").select(F.substring(F.sha2("engineer", 256), 1, 16).alias("engineer_id"), "n")


def gate() -> dict[str, Column]:
    checks = {
        "activation_4_of_5": F.col("activation_count") >= 4,
        "retention_70pct": F.coalesce(F.col("week2_retention_rate") >= 0.7, F.lit(False)),
        "decision_grade_tasks_10": F.col("valid_decision_grade_tasks") >= 10,
        "two_tasks_per_activated_engineer": (F.col("activation_count") == 0) | (F.col("least_tasks") >= 2),
        "context_reduction_50pct": F.coalesce(F.col("context_minutes_reduction") >= 0.5, F.lit(False)),
    }
    whole = F.lit(True)
    for c in checks.values():
        whole = whole & c
    return {**checks, "gate_ok": whole}


def miss_summaries(events: DataFrame, last: int = 10) -> DataFrame:
    """The last misses, by their lengths and the expected path's suffix only."""
    rows = events.filter("event = 'miss'").select(
        "line_no",
        F.col("raw_query_length").try_cast("long").alias("query_length"),
        F.length(F.coalesce("scrubbed_query", F.lit(""))).alias("scrubbed_query_length"),
        F.nullif(F.regexp_extract("expected_path", r"[^/](\.[^./]+)$", 1), F.lit("")).alias("expected_path_suffix"),
        F.col("expected_text_length").try_cast("long").alias("expected_text_length"),
    )
    return rows.orderBy(F.desc("line_no")).limit(last)
