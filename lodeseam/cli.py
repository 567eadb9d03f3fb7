"""Command line over the engine: python -m lodeseam.cli --db FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import re
import shutil
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import SECRET, Engine
from .operators import evaluate, pilot, usage
from .operators.providers import choose
from .session import build_session
from .sources import git, hooks
from .sources.jsonl import add_case, append_line, golden_cases, read_events
from .tools import serve


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodeseam")
    out.add_argument("--db", required=True, help="folder of the index, as a URI or path")
    out.add_argument("--dims", type=int, default=64)
    out.add_argument("--provider", default=os.environ.get("LODESEAM_PROVIDER", ""), help="ollama, openai, sentence or auto; hash vectors of --dims by default")
    out.add_argument("--model")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("index", "index-root"):
        p = commands.add_parser(name)
        p.add_argument("paths", nargs="+")
        p.add_argument("--include-worktrees", action="store_true")
        p.add_argument("--limit", type=int)
        p.add_argument("--max-seconds", type=float)
    commands.add_parser("reindex").add_argument("path", nargs="?")
    p = commands.add_parser("watch")
    p.add_argument("path", nargs="?")
    p.add_argument("--interval", type=float, default=5.0)
    p.add_argument("--once", action="store_true")
    commands.add_parser("prune")
    commands.add_parser("remove-repo").add_argument("name")
    commands.add_parser("backfill-vectors")
    commands.add_parser("install-hooks").add_argument("paths", nargs="+")
    p = commands.add_parser("pilot")
    p.add_argument("kind", choices=["start-task", "end-task", "activate", "retain", "miss"])
    p.add_argument("--log", required=True)
    p.add_argument("--fields", default="{}", help="the event's fields as JSON")
    p = commands.add_parser("eval-add")
    p.add_argument("golden")
    p.add_argument("case", help="a case as JSON")
    p = commands.add_parser("query")
    p.add_argument("text")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--repo")
    p.add_argument("--path-prefix")
    p.add_argument("--language")
    p.add_argument("--ranking", choices=["current", "rrf"], default="current")
    p.add_argument("--exact-lists", action="store_true")
    p.add_argument("--log", help="usage log that the search is noted in")
    commands.add_parser("get-symbol").add_argument("name")
    commands.add_parser("status")
    commands.add_parser("serve")
    commands.add_parser("doctor")
    commands.add_parser("report").add_argument("logs", nargs="+")
    p = commands.add_parser("eval")
    p.add_argument("golden")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--fail-under", type=float, default=0.0)
    return out


def _salt(folder: str) -> bytes:
    """The salt of the ids in this index's logs."""
    return hashlib.sha256(f"usage {folder}".encode()).digest()


def _show(df: DataFrame) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    folder = args.db if "://" in args.db else f"file://{os.path.abspath(args.db)}"
    engine = Engine(spark, folder, dims=args.dims, provider=choose(args.provider, args.model) if args.provider not in ("", "hash") else None)
    if args.command in ("index", "index-root"):
        failed = 0
        for path in args.paths:
            events = engine.index_root(path, args.limit, args.include_worktrees, args.max_seconds) if args.command == "index-root" else (engine.watch_once(path) for _ in range(1))
            for e in events:
                failed += e["event"] == "error"
                print(json.dumps(e))
        return int(failed > 0)
    if args.command == "reindex":
        print(json.dumps(engine.reindex(args.path)))
        return 0
    if args.command == "watch":
        watched = [args.path] if args.path else [r.repo_path for r in engine.repos().select("repo_path").collect()]
        failed = 0
        for e in engine.watch(watched, args.interval, args.once):
            failed += e["event"] == "error"
            if args.once or e["event"] != "unchanged":
                print(json.dumps(e), flush=True)
        return int(failed > 0 or not watched)
    if args.command == "prune":
        print(json.dumps({"removed": engine.prune(os.path.isdir)}))
    elif args.command == "remove-repo":
        gone = engine.remove_repo(args.name)
        print(json.dumps(gone))
        return int(gone is None)
    elif args.command == "backfill-vectors":
        print(json.dumps({"embedded": engine.backfill_vectors(), "complete": engine.covered()}))
    elif args.command == "install-hooks":
        for path in args.paths:
            hooks.install(git.root(path), folder)
        print(json.dumps(hooks.summary([hooks.inspect(git.root(p)) for p in args.paths])))
    elif args.command == "pilot":
        make = {"start-task": pilot.task_start, "end-task": pilot.task_end, "activate": pilot.activation, "retain": pilot.retention, "miss": pilot.miss}[args.kind]
        made = make(salt=_salt(folder), **json.loads(args.fields))
        append_line(args.log, made, strict=True)
        print(json.dumps(made))
    elif args.command == "eval-add":
        add_case(args.golden, json.loads(args.case), lambda text: re.search(SECRET, text))
    elif args.command == "query":
        began = time.perf_counter()
        asked = spark.createDataFrame([(1, args.text)], "query_id long, query_text string")
        found = engine.search(asked, args.k, args.repo, args.path_prefix, args.language, args.ranking, args.exact_lists)
        rows = engine.with_state(found, engine.probed_heads()).orderBy("position").select("repo_id", "path", "start_line", "end_line", "score", "language", "symbol_name", "is_stale", "has_dirty_tracked_files", F.col("content").alias("snippet")).collect()
        for r in rows:  # at most k
            print(json.dumps(r.asDict()))
        if args.log:
            append_line(args.log, pilot.search(args.text, [r.asDict() for r in rows], (time.perf_counter() - began) * 1000, _salt(folder), k=args.k, repo=args.repo))
    elif args.command == "get-symbol":
        _show(engine.symbol(spark.createDataFrame([(args.name,)], "name string")))
    elif args.command == "serve":
        serve(engine, sys.stdin, sys.stdout)
    elif args.command == "status":
        _show(engine.list_repos(engine.probed_heads()))
    elif args.command == "doctor":
        chunks = engine.table("chunks")
        known = [r.repo_path for r in engine.repos().select("repo_path").collect()]
        there = [p for p in known if os.path.isdir(p)]
        print(json.dumps({"spark": spark.version, "git": bool(shutil.which("git")), "index": chunks is not None, "chunks": chunks.count() if chunks is not None else 0, "vectors_complete": engine.covered(), "fts_version": engine.state()["meta"].get("fts_version"), "repos": len(known), "repos_missing": len(known) - len(there), "hooks": hooks.summary([hooks.inspect(p) for p in there])}))
    elif args.command == "report":
        events, bad = read_events(spark, args.logs)
        _show(usage.report(events).crossJoin(bad))
    else:
        cases = golden_cases(spark, args.golden).withColumn("query_id", F.xxhash64("id"))
        found = engine.search(cases.select("query_id", F.col("query").alias("query_text")), args.k)
        results = found.select("query_id", F.col("position").alias("rank"), "path", F.col("content").alias("snippet"))
        row = evaluate.recall(evaluate.first_hits(results, cases.select("query_id", "expected_path", "expected_text")), args.k).first()
        print(json.dumps(row.asDict()))
        return int(row.recall_at_k < args.fail_under)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session("lodeseam-cli", **{"spark.ui.showConsoleProgress": "false"})
    return run(args, spark)


if __name__ == "__main__":
    sys.exit(main())
