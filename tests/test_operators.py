import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseam.operators import evaluate, incremental, maintenance, retrieval, usage

CHUNKS = "chunk_id string, repo_id string, repo_path string, path string, language string, symbol_name string, symbol_confidence string, start_line int, content string, embedding_model string"


def chunk(i, path, content, name=None, confidence=None, repo="r"):
    return (i, repo, f"/{repo}", path, "python", name, confidence, 1, content, "m")


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [chunk("a", "src/retry.py", "def retry_request(attempt): backoff", "retry_request", "parser"), chunk("b", "src/other.py", "def other(): retry once", "other", "regex"), chunk("c", "docs/readme.md", "how retry works"), chunk("d", "src/none.py", "nothing here")]
    return spark.createDataFrame(rows, CHUNKS)


def test_bm25_equals_sqlite(spark, chunks):
    from lodeseam.functions import text

    rows = chunks.select("chunk_id", *[text.normalized(c).alias(c) for c in ("path", "symbol_name", "content")]).collect()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(chunk_id unindexed, path, symbol_name, content)")
    db.executemany("insert into f values (?, ?, ?, ?)", [tuple(r) for r in rows])
    want = {i: -s for i, s in db.execute("select chunk_id, bm25(f) from f where f match 'other OR nothing OR backoff'")}
    queries = spark.createDataFrame([(1, "other nothing backoff")], "query_id long, query_text string")
    got = {r.chunk_id: r.bm25 for r in retrieval.bm25(queries, retrieval.prepared(chunks, retrieval.query_terms(queries))).collect()}
    # query expansion adds words; only those of the query occur here besides "retry", "attempt"
    assert set(want) <= set(got)
    assert got["d"] == pytest.approx(want["d"], abs=1e-6)


def test_filters(chunks):
    ids = lambda **k: {r.chunk_id for r in retrieval.filtered(chunks, **k).collect()}
    assert ids(path_prefix="SRC/") == {"a", "b", "d"} and ids(path_prefix="s_c/") == {"a", "b", "d"} and ids(path_prefix="") == {"a", "b", "c", "d"}
    assert ids(repo="/r") == ids(repo="r") == {"a", "b", "c", "d"} and ids(model="x") == set()


def test_minmax(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 3.0), (2, 3.0), (3, 1.0), (3, 3.0), (3, 2.0)], "query_id long, s double")
    got = sorted((r.query_id, r.n) for r in retrieval.minmax(df, "s", "n").collect())
    assert got == [(1, 1.0), (2, 0.25), (2, 0.25), (3, 0.0), (3, 0.5), (3, 1.0)]


LISTS = "query_id long, source string, chunk_id long, rank int, path string, start_line int"


def test_rrf(spark):
    rows = [(1, "fts", 1, 1, "a", 1), (1, "fts", 2, 2, "b", 1), (1, "vector", 2, 1, "b", 1), (1, "vector", 3, 2, "c", 1), (1, "vector", 4, 3, "d", 1)]
    got = retrieval.rrf(spark.createDataFrame(rows, LISTS)).orderBy("rank").collect()
    assert [r.chunk_id for r in got][:3] == [2, 1, 3] and got[0].source_ranks == {"fts": 2, "vector": 1}
    rows = [(1, "fts", 1, 1, "b.py", 1), (1, "vector", 2, 1, "c.py", 1), (1, "path", 3, 1, "a.py", 1)]
    got = retrieval.rrf(spark.createDataFrame(rows, LISTS), bonus=True).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [3, 1, 2] and got[0].rrf_score == pytest.approx(1 / 61 + 0.05)


def test_diversified(spark):
    rng = random.Random(1)
    rows = [(q, i, "r", rng.choice("abc"), 1, None, float(rng.randint(0, 5))) for q in range(20) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, repo_id string, path string, start_line int, symbol_confidence string, score double")
    got = {}
    for r in retrieval.diversified(df, F.lit(3)).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q in range(20):
        order = sorted([r for r in rows if r[0] == q], key=lambda r: (-r[6], len(r[3]), r[4], r[1]))
        chosen, later, seen = [], [], {}
        for r in order:
            seen[r[3]] = seen.get(r[3], 0) + 1
            (chosen if seen[r[3]] <= 2 else later).append(r[1])
        assert got[q] == (chosen + later)[:3]


def test_symbol_lookup(spark):
    rows = [chunk("1", "a", "x", "RetryHandler", "regex"), chunk("2", "b", "x", "RetryHandler", "parser"), chunk("3", "c", "x", "Handler", "regex"), chunk("4", "d", "x", "MyHandlerBase", "parser")]
    got = {r.name: r.chunk_id for r in retrieval.symbol_lookup(spark.createDataFrame([("retryhandler",), ("handlerb",), ("none",), ("",)], "name string"), spark.createDataFrame(rows, CHUNKS)).collect()}
    assert got == {"retryhandler": "2", "handlerb": "4", "": "2"}


def test_hybrid_orders_and_union_plans(spark, chunks):
    queries = spark.createDataFrame([(1, "retry request", [1.0, 0.0])], "query_id long, query_text string, query_vector array<double>")
    with_vectors = chunks.withColumn("vector", F.when(F.col("chunk_id") == "a", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    full = retrieval.hybrid(queries, with_vectors, 10).orderBy(*retrieval.result_order()).collect()
    assert len(full) == 4 and full[0].chunk_id == "a" and full[0].symbol == 1.0 and full[0].vector == 1.0
    assert next(r for r in full if r.chunk_id == "c").multiplier == 0.70
    some = retrieval.hybrid(queries, with_vectors, 10, candidates=spark.createDataFrame([(1, "a"), (1, "a")], "query_id long, chunk_id string")).collect()
    assert len(some) == 1 and some[0].score == full[0].score


def test_union_plan(spark):
    queries = spark.createDataFrame([(1, "retry", 10), (2, "retry", 10), (3, "retry", 10), (4, "retry docs", 10), (5, "retry", None), (6, "retry", 10)], "query_id long, query_text string, k int")
    pairs = lambda *sizes: spark.createDataFrame([(q, f"{q}-{start + i}") for q, start, n in sizes for i in range(n)], "query_id long, chunk_id string")
    near = pairs((2, 0, 10), (3, 0, 10), (4, 0, 200), (5, 0, 200), (6, 0, 60))
    words = pairs((1, 0, 100), (3, 5, 10), (4, 0, 10), (5, 0, 10), (6, 20, 80))
    got = lambda *how: {r.query_id for r in retrieval.union_plan(queries, near, words, "k", *how).collect() if r.by_union}
    # 1 has no near vectors, 2 enough of them alone, 3 too few in all, 4 asks for documents, 5 for all, 6 has 100 together
    assert got(10**6, True) == {2, 6} and got(5, True) == got(10**6, False) == set()


def test_first_rows_keep_what_diversifying_needs():
    from lodeseam.operators import scoring

    rng = np.random.default_rng(3)
    for _ in range(200):
        n, k = int(rng.integers(1, 40)), int(rng.integers(1, 8))
        score, files = rng.integers(0, 6, n).astype(float), rng.integers(0, 5, n)
        tie = rng.permutation(n)
        order = sorted(range(n), key=lambda i: (-score[i], tie[i]))
        early, late, seen = [], [], {}
        for i in order:
            seen[files[i]] = seen.get(files[i], 0) + 1
            (early if seen[files[i]] <= 2 else late).append(i)
        kept = set()
        for batch in np.array_split(rng.permutation(n), 3):
            at = scoring.first_rows(score[batch], tie[batch], np.ones(len(batch), bool), k, files[batch], 2)
            kept |= set(batch[at].tolist())
        assert set((early + late)[:k]) <= kept and set(order[:k]) <= kept


def test_worker_tokens_equal_columns(spark):
    from lodeseam.functions import text

    rng = random.Random(8)
    texts = ["".join(rng.choice("aB1_ .é9Zß\n-") for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.tokens("t").alias("w")).collect()
    assert all(text.token_list(r.t) == list(r.w) for r in rows)


def test_hash_embedding_whole_table(spark, sf):
    """Every document's vector against the rule written out."""
    import hashlib
    import re

    from lodeseam.functions import vectors

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.embedding for r in vectors.hash_embeddings(docs, "doc_id", "text", 64).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = np.zeros(64)
        for word in re.findall("[A-Za-z_][A-Za-z0-9_]*|[0-9]+", r.text or ""):
            for part in re.sub("([A-Z])", r"_\1", word).lower().split("_"):
                if part:
                    d = hashlib.blake2b(part.encode(), digest_size=8).digest()
                    want[int.from_bytes(d[:4], "big") % 64] += 1 if d[4] & 1 else -1
        length = np.sqrt((want**2).sum())
        assert np.allclose(got[r.doc_id], want / (length or 1.0))


def test_syntax_chunks_whole_table(spark, sf):
    """Every Python document's symbols against a walk over its tree."""
    import ast

    from lodeseam.operators import chunker

    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("path like '%.py'").selectExpr("cast(doc_id as string) as repo_id", "path", "text as content")
    got = {}
    for r in chunker.syntax_chunks(docs).collect():
        got.setdefault(r.repo_id, []).append((r.symbol_name, r.symbol_kind, r.start_line, r.end_line, r.content))
    for r in docs.collect():
        want = []
        try:
            tree = ast.parse(r.content or "")
        except (SyntaxError, ValueError):
            tree = ast.Module([], [])
        for node in ast.walk(tree):
            node.inner = getattr(node, "inner", [])
            for child in ast.iter_child_nodes(node):
                child.inner = [*node.inner, node]
        for node in ast.walk(tree):
            places = [type(x).__name__ for x in node.inner]
            is_class = isinstance(node, ast.ClassDef)
            if (is_class or isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef))) and (places == ["Module"] or (places == ["Module", "ClassDef"] and not is_class)) and node.end_lineno - node.lineno < 80:
                first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
                want.append((node.name, "class" if is_class else "function", first, node.end_lineno, "\n".join(r.content.split("\n")[first - 1 : node.end_lineno])))
        assert sorted(got.get(r.repo_id, [])) == sorted(want)


# -- intervals and maintenance -----------------------------------------------------------------------------------------


def test_interval_algebra(spark):
    rng = random.Random(2)
    avail = [(k, a, a + rng.randint(0, 6)) for k in "xyz" for a in [rng.randint(0, 30) for _ in range(6)]] + [("x", 5, 4), ("x", None, 3), (None, 1, 2)]
    done = [(k, a, a + rng.randint(0, 4)) for k in "xyw" for a in [rng.randint(0, 30) for _ in range(6)]]
    schema = "k string, lo long, hi long"
    cover = lambda rows: {(k, s) for k, a, b in rows if a is not None and b is not None for s in range(a, b + 1)}
    a, d = spark.createDataFrame(avail, schema), spark.createDataFrame(done, schema)
    gaps = incremental.subtract(a, d, ["k"])
    assert {(r.k, r.seq) for r in incremental.expand(gaps, ["k"]).collect()} == cover(avail) - cover(done)
    merged = [tuple(r) for r in incremental.merge(a, ["k"]).collect()]
    assert cover(merged) == cover(avail) and len(cover(merged)) == sum(b - a + 1 for _, a, b in merged)
    again = incremental.intervals(incremental.expand(gaps, ["k"]), ["k"])
    assert sorted(map(str, again.collect())) == sorted(map(str, gaps.collect()))
    assert incremental.subtract(a.limit(0), d, ["k"]).count() == 0


def test_ledger_survives_failures(spark, tmp_path):
    ledger = incremental.Ledger(spark, f"file://{tmp_path}/ledger", ["repo"])
    records = lambda *rows: spark.createDataFrame(list(rows), "repo string, seq long, value string")
    first = records(("a", 1, "x"), ("a", 2, "y"), ("a", 5, "z"), ("b", 1, "w"))
    assert ledger.run(first, lambda df: df) == 1

    def fail(df):
        raise RuntimeError("lost")

    later = first.unionByName(records(("a", 3, "late"), ("a", 6, "new"), ("a", 3, "late")))
    with pytest.raises(RuntimeError):
        ledger.run(later, fail)
    assert ledger.output().count() == 4 and ledger.state()["number"] == 1
    assert ledger.run(later, lambda df: df) == 2
    assert ledger.run(later, lambda df: df) == 3  # nothing to do
    assert sorted((r.repo, r.seq) for r in ledger.output().collect()) == [("a", 1), ("a", 2), ("a", 3), ("a", 5), ("a", 6), ("b", 1)]
    assert sorted((r.repo, r.lo, r.hi) for r in ledger.processed(first).collect()) == [("a", 1, 3), ("a", 5, 6), ("b", 1, 1)]


def test_ledger_numbers_stay(spark, tmp_path):
    ledger = incremental.Ledger(spark, f"file://{tmp_path}/ledger", ["repo"], ["path", "hash"])
    records = lambda *rows: spark.createDataFrame(list(rows), "repo string, path string, hash string, extra int")
    first = records(("a", "x", "1", 7), ("a", "y", None, 8), ("a", "x", "1", 9), (None, "x", "1", 1))
    assert ledger.run(first, lambda df: df) == 1
    numbers = lambda: {(r.repo, r.path, r.hash): r.seq for r in spark.read.parquet(*[f"{ledger.folder}/{n}/numbers" for n in ledger.state()["numbers"]]).collect()}
    before = numbers()
    assert sorted(before.values()) == [1, 1, 2]
    # a record that sorts in front of all others and a new version
    assert ledger.run(first.unionByName(records(("a", "a", "0", 1), ("a", "x", "2", 1))), lambda df: df) == 2
    after = numbers()
    assert all(after[k] == v for k, v in before.items()) and sorted(v for k, v in after.items() if k[0] == "a") == [1, 2, 3, 4]
    assert {(r.path, r.hash) for r in ledger.output_of(2).collect()} == {("a", "0"), ("x", "2")}
    assert ledger.output().count() == 5


def test_ledger_of_two_runs_one_commits(spark, tmp_path):
    one, two = (incremental.Ledger(spark, f"file://{tmp_path}/ledger", ["repo"]) for _ in range(2))
    records = spark.createDataFrame([("a", 1), ("a", 2)], "repo string, seq long")

    def meanwhile(df):
        two.run(records, lambda x: x)
        return df

    with pytest.raises(RuntimeError, match="another run"):
        one.run(records, meanwhile)
    assert one.output().count() == 2 and one.state()["number"] == 1


def test_ledger_crash_before_the_commit(spark, tmp_path, monkeypatch):
    ledger = incremental.Ledger(spark, f"file://{tmp_path}/ledger", ["repo"], ["path"])
    records = spark.createDataFrame([("a", "x"), ("a", "y")], "repo string, path string")
    with monkeypatch.context() as m:
        m.setattr(ledger.manifest, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ledger.run(records, lambda df: df)
    assert ledger.output() is None  # written, but it counts for nothing
    assert ledger.run(records, lambda df: df) == 1 and ledger.output().count() == 2


def test_created_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from lodeseam.session import create_file, read_file

    path = f"file://{tmp_path}/commit-1.json"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: create_file(spark, path, str(i).encode()), range(8)))
    assert won.count(True) == 1 and read_file(spark, path) == str(won.index(True)).encode()
    assert read_file(spark, f"{tmp_path}/none") is None
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


TREE = "repo_id string, path string, commit_sha string, content_hash string, committed_at string, arrived_at string"
STATE = "repo_id string, path string, content_hash string, indexed_at string"


def test_pending_files(spark):
    tree = [("r", "same", "c2", "AB", "2", "2"), ("r", "changed", "c2", "cd", "2", "2"), ("r", "new", "c2", "ef", "2", "2"), ("r", "old", "c1", "00", "1", "9"), ("r", "nullstate", "c2", "11", "2", "2"), ("r", "emptystate", "c2", "12", "2", "2"), ("r", "same", "c2", "AB", "2", "2"), ("s", "only", "d1", None, "1", "1"), (None, "x", "c", "1", "1", "1"), ("r", None, "c2", "1", "2", "2")]
    state = [("r", "same", "xx", "1"), ("r", "same", "sha256:ab", "2"), ("r", "changed", "CD", "1"), ("r", "changed", "zz", "2"), ("r", "nullstate", "11", "1"), ("r", "nullstate", None, "2"), ("r", "emptystate", "", "2"), ("r", "gone", "1", "1"), ("s", "only", None, "1")]
    got = {(r.repo_id, r.path) for r in incremental.pending_files(spark.createDataFrame(tree, TREE), spark.createDataFrame(state, STATE), blocks=2).collect()}
    assert got == {("r", "changed"), ("r", "new"), ("r", "nullstate"), ("r", "emptystate"), ("s", "only")}
    empty = spark.createDataFrame([], TREE), spark.createDataFrame([], STATE)
    assert incremental.pending_files(*empty).count() == 0


def test_maintenance(spark):
    old = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "path string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, h string")
    assert {r.path: r.change for r in maintenance.snapshot_diff(old, new, ["path"], "h").collect()} == {"a": "same", "b": "changed", "c": "removed", "d": "added"}
    assert {r.path: r.h for r in maintenance.upsert(old, new, ["path"]).collect()} == {"a": "1", "b": "2", "c": "3", "d": "4"}
    assert {r.path: r.h for r in maintenance.upsert(old, new, ["path"], keep=["h"]).collect()} == {"a": "1", "b": None, "c": "3", "d": "4"}
    assert maintenance.migrated(old, {"error_count": 0}).columns == ["path", "h", "error_count"]
    repos = spark.createDataFrame([("i1", "/p"), ("i2", "/q")], "repo_id string, repo_path string")
    assert [r.repo_id for r in maintenance.aliases(repos, spark.createDataFrame([("i9", "/p")], "repo_id string, repo_path string")).collect()] == ["i1"]


# -- evaluation and usage ----------------------------------------------------------------------------------------------


def test_recall(spark):
    results = spark.createDataFrame([(1, 1, "a", "no"), (1, 2, "a", "the Right text"), (2, 3, "b", ""), (3, 1, "x", "")], "query_id long, rank int, path string, snippet string")
    cases = spark.createDataFrame([(1, "a", "right"), (2, "b", None), (3, "c", "")], "query_id long, expected_path string, expected_text string")
    hits = evaluate.first_hits(results, cases)
    assert {r.query_id: r.hit_rank for r in hits.collect()} == {1: 2, 2: 3, 3: None}
    row = evaluate.recall(hits, 10).first()
    assert (row.total, row.hits) == (3, 2) and row.mrr == pytest.approx((1 / 2 + 1 / 3) / 3)
    assert evaluate.recall(hits.limit(0), 10).first().mrr == 0.0


def test_percentiles(spark):
    values = [float(i * i % 17) for i in range(23)]
    df = spark.createDataFrame([("k", v) for v in values] + [("k", None), ("e", 1.0)], "key string, v double")
    got = {r.key: r for r in evaluate.telemetry(df, "key", "v").collect()}
    ordered = sorted(values)
    assert got["k"].p50 == ordered[math.floor(22 * 0.5)] and got["k"].p95 == ordered[math.floor(22 * 0.95)] and got["e"].p50 == 1.0


def test_usage_report(spark, tmp_path):
    import json

    from lodeseam.sources.jsonl import read_events

    ok = {c: True for c in usage.ACTIVATION_CHECKS}
    events = [{"ts": 1, "event": "activation", "engineer": e, **ok} for e in "abcd"]
    events += [{"ts": 2, "event": "retention", "engineer": "a", "week2": True, "enabled": False}, {"ts": 3, "event": "retention", "engineer": "a", "week2": True, "enabled": True}]
    events += [{"event": "task_start", "task_id": t, "engineer": "a"} for t in ("t1", "t2", "t3")]
    end = {"event": "task_end", "engineer": "a", "decision_grade": True, "useful": "yes", "mcp_queries": 2, "baseline_source": "prior_comparable"}
    events += [{**end, "task_id": "t1", "baseline_minutes": 10, "tool_minutes": 4}, {**end, "task_id": "t2", "baseline_minutes": "x", "tool_minutes": 4}]
    events += [{**end, "task_id": "t3", "baseline_minutes": 10, "tool_minutes": 1}] * 2 + [{**end, "task_id": "t9", "baseline_minutes": 10, "tool_minutes": 1}]
    events += [{"event": "search", "result_count": 0, "latency_ms": 5}, {"event": "search", "result_count": 3, "latency_ms": 7}, {"event": "miss", "raw_query_length": 4, "scrubbed_query": "abcd", "expected_path": "x/y.py"}]
    (tmp_path / "log.jsonl").write_text("\n".join([*map(json.dumps, events), "not-json", "[]", ""]))
    parsed, bad = read_events(spark, [str(tmp_path / "log.jsonl"), str(tmp_path / "missing.jsonl")])
    assert bad.first().bad_line_count == 2
    row = usage.report(parsed).first()
    assert row.activation_count == 4 and row.week2_retention_rate == 0.25 and row.valid_decision_grade_tasks == 1 and row.duplicate_task_end_count == 1
    assert row.context_minutes_reduction == pytest.approx(0.6) and row.zero_result_rate == 0.5 and row.median_query_latency_ms == 6.0 and row.gate_ok is False
    assert usage.miss_summaries(parsed).first().expected_path_suffix == ".py"
    assert usage.report(parsed.limit(0)).first().zero_result_rate is None
