import pytest

from lodeseam.engine import Engine
from lodeseam.streaming import ingest

FILES = "repo_id string, repo_path string, path string, commit_sha string, content string"


def snapshot(spark, **contents):
    return spark.createDataFrame([("r", "/r", p.replace("__", "/").replace("_py", ".py"), "c1", t) for p, t in contents.items()], FILES)


def test_incremental_equals_full(spark, tmp_path):
    long = "def handle_retry():\n    return 'retry the request after a pause of some length'\n"
    engine = Engine(spark, f"file://{tmp_path}/one", dims=16, ignore="skipme/\n")
    first = snapshot(spark, a_py=long, b_py="def other_thing():\n    return 'something else that is long enough'\n", skipme__c_py=long, secret_py="key = 'AKIA" + "ABCDEFGHIJKLMNOP'\n")
    got = engine.index(first)
    assert got["files_changed"] == 2 and got["chunks_total"] > 0
    assert engine.index(first)["files_changed"] == 0
    second = snapshot(spark, a_py=long + "# more\n", d_py=long)
    got = engine.index(second)
    assert (got["files_changed"], got["files_removed"]) == (2, 1)
    full = Engine(spark, f"file://{tmp_path}/two", dims=16, ignore="skipme/\n")
    full.index(second)
    ids = lambda e: sorted(r.chunk_id for r in e.table("chunks").select("chunk_id").collect())
    assert ids(engine) == ids(full)
    changed = Engine(spark, f"file://{tmp_path}/one", dims=32)
    assert changed.index(second)["files_changed"] == 2  # another model
    found = engine.search(spark.createDataFrame([(1, "handle retry")], "query_id long, query_text string"), k=2) if engine.model == changed.model else changed.search(spark.createDataFrame([(1, "handle retry")], "query_id long, query_text string"), k=2)
    assert found.count() == 2 and "content" in found.columns
    assert changed.symbol(spark.createDataFrame([("handle_retry",)], "name string")).count() == 1
    assert changed.status().first().chunk_count == changed.table("chunks").count()


QUERY = "query_id long, query_text string"
LONG = "def {0}():\n    return 'some text that is long enough to be indexed as a chunk'\n"


def files_of(spark, repo, commit, **contents):
    rows = [(repo, f"/{repo}", p.replace("__", "/").replace("_py", ".py"), commit, t) for p, t in contents.items()]
    return spark.createDataFrame(rows, FILES)


def test_repository_state(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/index", dims=16)
    engine.index(files_of(spark, "a", "c1", one_py=LONG.format("first_thing"), two_py=LONG.format("second_thing")))
    engine.index(files_of(spark, "b", "d1", three_py=LONG.format("third_thing")))
    state = lambda: {r.repo_id: (r.last_commit_sha, r.error_count, r.last_error) for r in engine.repos().collect()}
    assert state() == {"a": ("c1", 0, None), "b": ("d1", 0, None)}
    engine.record_failure("a", "/a", "lost")
    engine.record_failure("a", "/a", "lost again")
    assert state()["a"] == ("c1", 2, "lost again")
    heads = spark.createDataFrame([("a", "c1", True), ("b", "d1", False)], "repo_id string, head string, dirty boolean")
    listed = {r.repo_id: r for r in engine.list_repos(heads).collect()}
    assert listed["a"].is_stale and listed["a"].has_dirty_tracked_files and not listed["b"].is_stale and listed["b"].chunk_count > 0
    engine.index(files_of(spark, "a", "c2", one_py=LONG.format("first_thing")))
    assert state()["a"] == ("c2", 0, None) and engine.total_chunks() == engine.table("chunks").count()
    # an empty snapshot of a known repository removes all its files
    got = engine.index(files_of(spark, "a", "c3", one_py="x").limit(0), repos=spark.createDataFrame([("a", "/a", "c3")], "repo_id string, repo_path string, commit_sha string"))
    assert got["files_removed"] == 1 and {r.repo_id for r in engine.table("chunks").collect()} == {"b"} and state()["a"][0] == "c3"
    # the same path under a new id: the old one goes
    moved = files_of(spark, "b", "d2", three_py=LONG.format("third_thing")).selectExpr("'new' as repo_id", "repo_path", "path", "commit_sha", "content")
    engine.index(moved)
    assert set(state()) == {"a", "new"} and {r.repo_id for r in engine.table("indexed_files").collect()} == {"new"}
    assert engine.remove_repo("nobody") is None
    removed = engine.remove_repo("/b")
    assert removed["repo_id"] == "new" and removed["chunks_removed"] > 0 and engine.table("chunks").count() == 0
    assert engine.prune(lambda p: False) == ["a"] and engine.repos().count() == 0
    assert engine.vacuum() > 0


def test_two_runs_one_commits(spark, tmp_path):
    one, two = Engine(spark, f"{tmp_path}/index", dims=16), Engine(spark, f"{tmp_path}/index", dims=16)
    one.index(files_of(spark, "a", "c1", one_py=LONG.format("first_thing")))

    def meanwhile(files):
        two.index(files_of(spark, "a", "c2", one_py=LONG.format("other_thing")))
        from lodeseam.operators.chunker import chunk_files

        return chunk_files(files)

    one.chunk = meanwhile
    with pytest.raises(RuntimeError, match="another run"):
        one.index(files_of(spark, "a", "c3", one_py=LONG.format("late_thing")))
    assert {r.last_commit_sha for r in one.repos().collect()} == {"c2"} and "other_thing" in {r.symbol_name for r in two.table("chunks").collect()}


def stub():
    class Stub:  # defined here, so that workers get it by value
        """Vectors of four numbers; texts with the word "broken" can't be embedded."""

        model_id, dimensions = "stub", 4

        def embed_batch(self, texts):
            if any("broken" in t for t in texts):
                raise ValueError("refused")
            return [[1.0, float(len(t) % 7), 0.0, 0.0] for t in texts]

    return Stub()


def test_provider_failures_and_cache(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/index", provider=stub())
    got = engine.index(files_of(spark, "a", "c1", one_py=LONG.format("first_thing"), two_py=LONG.format("broken_thing")))
    assert got["files_failed"] == 1 and {r.path for r in engine.table("indexed_files").collect()} == {"one.py"}
    repo = engine.repos().first()
    assert (repo.last_commit_sha, repo.error_count, repo.last_error) == ("", 1, "refused")
    asked = spark.createDataFrame([(1, "first thing")], QUERY)
    assert engine.search(asked, 1).first().path == "one.py"
    rows = engine.table("query_cache").collect()
    assert len(rows) == 1 and "first" not in str(rows) and rows[0].model == "stub"
    number = engine.state()["number"]
    engine.search(asked, 1)
    assert engine.state()["number"] == number  # the second time nothing is embedded
    engine.index(files_of(spark, "a", "c2", one_py=LONG.format("first_thing"), two_py=LONG.format("mended_thing")))
    assert engine.repos().first().error_count == 0 and engine.covered()


def test_ranking_modes_and_filters(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/index", dims=32)
    engine.index(files_of(spark, "a", "c1", src__retry_py=LONG.format("retry_handler"), src__other_py=LONG.format("parse_config"), docs__x_py=LONG.format("retry_docs")))
    engine.index(files_of(spark, "b", "d1", src__retry_py=LONG.format("retry_client")))
    asked = spark.createDataFrame([(1, "retry handler"), (2, "zzzz qqqq")], QUERY)
    found = engine.search(asked, 3, ranking="rrf", exact_lists=True, bonus=True).collect()
    modes = {(r.query_id, r.ranking_mode, r.rrf_disabled_reason) for r in found}
    assert modes == {(1, "rrf", None), (2, "current", "no_fts_candidates")}
    assert next(r for r in found if r.query_id == 1 and r.position == 1).symbol_name == "retry_handler"
    assert {r.repo_id for r in engine.search(asked, 9, repo="/b").collect()} == {"b"}
    assert {r.path for r in engine.search(asked, 9, path_prefix="SRC/re").collect()} == {"src/retry.py"}
    assert engine.search(asked, 9, language="go").count() == 0
    plain = engine.search(asked.limit(1), 1, debug=True).first()
    assert plain.path == "src/retry.py" and plain.bm25_score == 1.0 and plain.multiplier == 1.0
    # the stored text is made anew when its version changes, with the same results
    before = sorted((r.query_id, r.chunk_id, r.score) for r in engine.search(asked, 5).collect())
    state = engine.state()
    engine.manifest.commit(state, {**state, "meta": {**state["meta"], "fts_version": 0}})
    assert sorted((r.query_id, r.chunk_id, r.score) for r in engine.search(asked, 5).collect()) == before and engine.state()["meta"]["fts_version"] == 1
    symbols = {r["name"]: r for r in engine.symbol(spark.createDataFrame([("retry_handler",), ("config parser",)], "name string")).collect()}
    assert symbols["retry_handler"].path == "src/retry.py" and symbols["config parser"].symbol_name == "parse_config"
    cases = spark.createDataFrame([(1, "retry handler", "src/retry.py", "retry_handler"), (2, "retry", "none.py", "")], QUERY + ", expected_path string, expected_text string")
    diagnosed = {r.query_id: r for r in engine.expected_path(cases).collect()}
    assert diagnosed[1].found and diagnosed[1].text_match and diagnosed[1].expected_rank == 1 and not diagnosed[2].found
    # vectors that are lacking are made
    state = engine.state()
    chunks = engine.table("chunks")
    part = engine._part("chunks", chunks.selectExpr("* except (embedding)", "cast(null as array<double>) as embedding").select(*chunks.columns))
    engine.manifest.commit(state, {**state, "parts": {**state["parts"], "chunks": {i: part for i in state["parts"]["chunks"]}}})
    assert not engine.covered() and engine.backfill_vectors() == chunks.count() and engine.covered()


def test_union_of_candidates(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/index", dims=32)
    many = {f"src__f{i}_py": LONG.format(f"filler_{i}") for i in range(80)}
    engine.index(files_of(spark, "a", "c1", src__target_py=LONG.format("retry_handler"), **many))
    asked = spark.createDataFrame([(1, "retry handler"), (2, "readme of the retry handler")], QUERY)
    found = lambda **how: {(r.query_id, r.position): r for r in engine.search(asked, 3, **how).collect()}
    scan, union = found(), found(union_threshold=1)
    assert {r.candidate_path for r in scan.values()} == {"full_scan"}
    assert union[1, 1].candidate_path == "candidate_union" and union[2, 1].candidate_path == "full_scan"  # 2 asks for documents
    assert [union[q, 1].path for q in (1, 2)] == [scan[q, 1].path for q in (1, 2)] == ["src/target.py"] * 2
    assert found(union_threshold=1, path_prefix="src/target")[1, 1].path == "src/target.py"


def test_files_that_become_unfit(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/index", dims=16)
    engine.index(files_of(spark, "a", "c1", one_py=LONG.format("first_thing")))
    got = engine.index(files_of(spark, "a", "c2", one_py="key = 'ghp_" + "a" * 24 + "'\n"))
    assert (got["files_secret"], got["files_removed"], got["chunks_total"]) == (1, 1, 0)


def test_stream(spark, tmp_path):
    schema = "repo_id string, repo_path string, path string, content string, indexed_at timestamp"
    source = str(tmp_path / "in")
    text = "def f():\n    return 'long enough to be indexed as a chunk of its own'\n"
    put = lambda t, content, path="a.py": spark.sql(f"select 'r' repo_id, '/r' repo_path, '{path}' path, cast({content} as string) content, timestamp'{t}' indexed_at").write.mode("append").parquet(source)
    quoted = "'" + text.replace("'", "\\'").replace("\n", "\\n") + "'"
    put("2025-01-01 00:00:00", quoted)
    put("2025-01-01 00:00:00", quoted, "b.py")
    go = lambda: ingest.ingest(spark, source, schema, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    go()
    now = lambda: {r.path for r in ingest.current(spark.read.parquet(str(tmp_path / "log"))).collect()}
    assert now() == {"a.py", "b.py"}
    put("2025-01-02 00:00:00", "null", "b.py")
    go()
    go()
    assert now() == {"a.py"}


def test_windowed_counts(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("cast(ts as timestamp) ts", "event_type")
    assert ingest.windowed_counts(events, "ts", "event_type").agg({"n": "sum"}).first()[0] == events.count()
    assert pytest is not None
