"""The engine over one folder of tables: ingest of file snapshots, search, symbols, repository state."""

from __future__ import annotations

import hashlib
import json
import secrets
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import paths, vectors
from .operators import chunker, embedding, maintenance, retrieval
from .operators.manifest import Manifest
from .session import materialize, spread
from .sources import git

SECRET = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}"
#: What the stored full text is made by; an index of another version is rebuilt.
FTS_VERSION = 1
CACHE_ROWS = 10_000
REPOS = "repo_id string, repo_path string, remote_url string, last_commit_sha string, indexed_at timestamp, last_error string, error_count int"
FILES = "repo_id string, path string, content_hash string, commit_sha string, embedding_model string, chunker_version string, indexed_at timestamp, chunk_count long"
CACHE = "key string, model string, embedding array<double>, at timestamp"


class Engine:
    """Every run writes parts of the tables it changes and makes them hold by one manifest, which also says for each
    repository which part its rows are read from. Readers see one state or the next; a run that fails, or that another
    overtook, leaves nothing that counts. Only the rows of repositories that a run touches are written again.
    """

    def __init__(self, spark: SparkSession, folder: str, dims: int = 64, model: str = "hash-v1", ignore: str = "", chunker_version: str = "windows80-10-symbols", least_bytes: int = chunker.LEAST_BYTES, provider: embedding.Provider | None = None, chunk: Callable[[DataFrame], DataFrame] = chunker.chunk_files) -> None:
        if least_bytes < 0:
            raise ValueError("least_bytes must not be negative")
        self.spark, self.folder = spark, folder.rstrip("/")
        self.provider, self.chunk, self.least_bytes = provider, chunk, least_bytes
        self.dims = provider.dimensions if provider else dims
        self.model = provider.model_id if provider else f"{model}:dims={dims}"
        self.rules = paths.ignore_rules(ignore)
        marks = hashlib.sha256(f"{ignore}\0{SECRET}".encode()).hexdigest()[:16]
        self.version = f"{chunker_version}+least{least_bytes}+{marks}"
        self.manifest = Manifest(spark, self.folder)

    # -- tables --------------------------------------------------------------------------------------------------

    def state(self) -> dict:
        return {"parts": {}, "tables": {}, "meta": {}, **self.manifest.current()}

    def table(self, name: str, state: dict | None = None) -> DataFrame | None:
        """A table as it holds now. Tables by repository (chunks, features, postings, indexed_files) are read from the
        parts of their repositories, others whole."""
        state = state or self.state()
        if name in state["tables"]:
            return self.spark.read.parquet(f"{self.folder}/{name}/{state['tables'][name]}")
        parts = state["parts"].get(name)
        if parts is None:
            return None
        if not parts:
            known = self.manifest_part(state, name)
            return known.limit(0).drop("part") if known is not None else None
        rows = self.spark.read.parquet(*[f"{self.folder}/{name}/{p}" for p in sorted(set(parts.values()))])
        holding = self.spark.createDataFrame(list(parts.items()), "repo_id string, part string")
        return rows.join(F.broadcast(holding), ["repo_id", "part"], "left_semi").drop("part")  # a row for each repository

    def manifest_part(self, state: dict, name: str) -> DataFrame | None:
        last = state["meta"].get(f"last_{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}/{last}") if last else None

    def _part(self, name: str, rows: DataFrame) -> str:
        part = uuid.uuid4().hex
        rows.withColumn("part", F.lit(part)).write.parquet(f"{self.folder}/{name}/{part}")
        return part

    def _whole(self, name: str, rows: DataFrame) -> str:
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/{name}/{version}")
        return version

    def vacuum(self) -> int:
        """Delete files that the current state doesn't name; for when no reader of an older state is left."""
        from .session import _hadoop

        state, gone = self.state(), 0
        live = {f"{n}/{p}" for n, parts in state["parts"].items() for p in parts.values()} | {f"{n}/{v}" for n, v in state["tables"].items()}
        live |= {f"{k[5:]}/{v}" for k, v in state["meta"].items() if k.startswith("last_")}
        files, root = _hadoop(self.spark, self.folder)
        for folder in [s for s in files.listStatus(root) if s.isDirectory()]:
            for version in files.listStatus(folder.getPath()):
                name = f"{folder.getPath().getName()}/{version.getPath().getName()}"
                if name not in live:
                    files.delete(version.getPath(), True)
                    gone += 1
        return gone

    # -- repository state ------------------------------------------------------------------------------------------

    def repos(self) -> DataFrame:
        known = self.table("repos")
        return known if known is not None else self.spark.createDataFrame([], REPOS)

    def _with_outcome(self, state: dict, runs: DataFrame) -> dict:
        known = self.table("repos", state)
        known = known if known is not None else self.spark.createDataFrame([], REPOS)
        return {**state, "tables": {**state["tables"], "repos": self._whole("repos", maintenance.outcome(known, runs))}}

    def record_failure(self, repo_id: str, repo_path: str, error: str, remote_url: str = "") -> None:
        """Count a failed run; the last commit that was indexed stays what it was."""
        state = self.state()
        run = self.spark.createDataFrame([(repo_id, repo_path, remote_url, None, error[:500])], "repo_id string, repo_path string, remote_url string, commit_sha string, error string")
        self.manifest.commit(state, self._with_outcome(state, run.withColumn("at", F.current_timestamp())))

    # -- ingest --------------------------------------------------------------------------------------------------

    def index(self, files: DataFrame, repos: DataFrame | None = None, removed: DataFrame | None = None) -> dict[str, int]:
        """Bring the index to a snapshot of files (repo_id, repo_path, path, commit_sha, content): only files that are new
        or changed, by content, model and chunker, are chunked; files no longer there, skipped, ignored or with a secret
        are removed. Counts of what happened are returned.

        repos: (repo_id, repo_path[, remote_url, commit_sha]) of the snapshot; needed where a repository may hold no file.
        Files that can't be embedded are left as they were, and their repository is recorded as failed, its commit kept.
        removed: (repo_id, path); given, files are not whole snapshots but what changed, and other files stay.
        """
        state = self.state()
        files = materialize(files.select("repo_id", "repo_path", "path", "commit_sha", "content"), "snapshot")  # read once: one snapshot
        own = files.groupBy("repo_id").agg(F.max("repo_path").alias("repo_path"), F.max("commit_sha").alias("commit_sha"))
        if repos is not None:
            given = repos.select("repo_id", "repo_path", *[F.col(c) if c in repos.columns else F.lit(None).cast("string").alias(c) for c in ("remote_url", "commit_sha")])
            touched = given.join(own.select("repo_id", F.col("commit_sha").alias("_sha")), "repo_id", "left").select("repo_id", "repo_path", "remote_url", F.coalesce("commit_sha", "_sha").alias("commit_sha"))
        else:
            touched = own.select("repo_id", "repo_path", F.lit(None).cast("string").alias("remote_url"), "commit_sha")
        touched = materialize(touched, "touched")
        names = files.withColumns({"skipped": paths.skip("path") | F.col("content").isNull(), "ignored": paths.ignored("path", self.rules)})
        names = names.withColumn("secret", ~F.col("skipped") & ~F.col("ignored") & F.coalesce(F.col("content").rlike(SECRET), F.lit(False)))
        left_out = names.agg(*[F.count_if(c).alias(c) for c in ("skipped", "ignored", "secret")]).first()
        fit = names.filter(~F.col("skipped") & ~F.col("ignored") & ~F.col("secret")).drop("skipped", "ignored", "secret")
        fit = fit.withColumn("content_hash", F.sha2("content", 256))
        stamp = {"embedding_model": F.lit(self.model), "chunker_version": F.lit(self.version)}
        fresh = fit.select("repo_id", "path", "content_hash", "commit_sha").withColumns(stamp)
        mark = F.concat_ws("|", "content_hash", "embedding_model", "chunker_version")
        known = self.table("indexed_files", state)
        old = (known if known is not None else self.spark.createDataFrame([], FILES)).join(touched.select("repo_id"), "repo_id", "left_semi")
        stays = None
        if removed is not None:
            named = files.select("repo_id", "path").unionByName(removed.select("repo_id", "path")).distinct()
            stays = old.join(named, ["repo_id", "path"], "left_anti")
            old = old.join(named, ["repo_id", "path"], "left_semi")
        diff = materialize(maintenance.snapshot_diff(old.withColumn("mark", mark), fresh.withColumn("mark", mark), ["repo_id", "path"], "mark"), "diff")
        changed = diff.filter("change in ('added', 'changed')").select("repo_id", "path")
        made = self.chunk(fit.join(changed, ["repo_id", "path"], "left_semi")).withColumn("keep", chunker.indexable(self.least_bytes)).withColumns(stamp)
        kept = made.filter("keep").drop("keep").withColumn("chunk_id", chunker.chunk_id()).dropDuplicates(["chunk_id"])
        kept = materialize(kept.join(fit.select("repo_id", "path", "commit_sha").distinct(), ["repo_id", "path"]), "made")
        embedded = materialize(self._embedded(kept), "embedded")
        failed = materialize(embedded.filter("error is not null").groupBy("repo_id", "path").agg(F.min("error").alias("error")), "failed")
        good = embedded.join(failed.select("repo_id", "path"), ["repo_id", "path"], "left_anti").drop("error")
        gone = diff.filter("change <> 'same'").select("repo_id", "path").join(failed.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
        gone = materialize(gone, "gone")
        parts = {n: dict(p) for n, p in state["parts"].items()}
        meta = {**state["meta"], "salt": state["meta"].get("salt") or secrets.token_hex(16), "fts_version": FTS_VERSION}
        ids = [r.repo_id for r in touched.select("repo_id").collect()]  # a row for each repository of the run
        stale_text = state["meta"].get("fts_version", FTS_VERSION) != FTS_VERSION

        def put(name: str, new: DataFrame, before: DataFrame | None) -> DataFrame:
            rows = new if before is None else maintenance.delete_paths(before.join(touched.select("repo_id"), "repo_id", "left_semi"), gone).select(*new.columns).unionByName(new)
            part = self._part(name, rows)
            parts[name] = {**parts.get(name, {}), **{i: part for i in ids}}
            meta[f"last_{name}"] = part
            return self.spark.read.parquet(f"{self.folder}/{name}/{part}").drop("part")

        chunks = put("chunks", good, self.table("chunks", state))
        text_of = chunks if stale_text else good
        put("features", self._features(text_of), None if stale_text else self.table("features", state))
        put("postings", self._postings(text_of), None if stale_text else self.table("postings", state))
        counts = chunks.groupBy("repo_id", "path").agg(F.count("*").alias("chunk_count"))
        done = fresh.join(failed.select("repo_id", "path"), ["repo_id", "path"], "left_anti").join(counts, ["repo_id", "path"], "left").fillna(0, ["chunk_count"]).withColumn("indexed_at", F.current_timestamp())
        still = old.join(failed.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
        columns = [c.split(" ")[0] for c in FILES.split(", ")]
        kept_files = done.select(*columns).unionByName(still.select(*columns))
        part = self._part("indexed_files", kept_files if stays is None else kept_files.unionByName(stays.select(*columns)))
        parts["indexed_files"] = {**parts.get("indexed_files", {}), **{i: part for i in ids}}
        meta["last_indexed_files"] = part
        errors = failed.groupBy("repo_id").agg(F.min("error").alias("error"))
        after = self._with_outcome({**state, "parts": parts, "meta": meta}, touched.join(errors, "repo_id", "left").withColumn("at", F.current_timestamp()))
        before = self.table("repos", state)
        before = before if before is not None else self.spark.createDataFrame([], REPOS)
        # a path that goes by another id now: the old id is dropped everywhere
        current = {r.repo_path: r.repo_id for r in touched.collect()}
        for r in before.filter(F.col("repo_path").isin(list(current))).select("repo_id", "repo_path").collect():
            if current[r.repo_path] != r.repo_id:
                after = self._without(after, [r.repo_id])
        self.manifest.commit(state, after)
        n = {r.change: r["count"] for r in diff.groupBy("change").count().collect()}
        return {
            "files_changed": n.get("added", 0) + n.get("changed", 0), "files_removed": n.get("removed", 0), "files_same": n.get("same", 0), "files_failed": failed.count(),
            "files_skipped": left_out.skipped, "files_ignored": left_out.ignored, "files_secret": left_out.secret, "chunks_indexed": good.count(), "chunks_total": self.table("chunks").count(),
        }

    def index_repo(self, path: str, ignore_name: str = ".lodeseamignore") -> dict:
        """Index the head of a git repository. Only what changed since the last indexed commit is read, unless there is
        none, the last run failed, or any of its files was indexed by another model, chunker or ignore file."""
        self.spark.dataSource.register(git.GitTreeSource)
        repo = git.root(path)
        commit = git.head(repo)
        try:
            engine = Engine(self.spark, self.folder, self.dims, ignore=git.ignore_text(repo, commit, ignore_name), least_bytes=self.least_bytes, provider=self.provider, chunk=self.chunk)
            engine.model = self.model
            state = [r for r in self.repos().filter(F.col("repo_id") == repo).collect()]
            known = self.table("indexed_files")
            mine = known.filter(F.col("repo_id") == repo) if known is not None else None
            since = state[0].last_commit_sha if state and not state[0].error_count else ""
            full = not since or mine is None or mine.isEmpty() or not mine.filter((F.col("embedding_model") != engine.model) | (F.col("chunker_version") != engine.version)).isEmpty()
            reader = self.spark.read.format("git_tree").option("repos", repo).option("commits", json.dumps({repo: commit}))
            own = self.spark.createDataFrame([(repo, repo, git.remote(repo), commit)], "repo_id string, repo_path string, remote_url string, commit_sha string")
            own = own.withColumn("remote_url", paths.sanitized_remote("remote_url"))
            if full:
                counts = engine.index(reader.load(), own)
            else:
                gone = sorted(git.changes(repo, since, commit)[1])
                removed = self.spark.createDataFrame([(repo, p) for p in gone], "repo_id string, path string")
                counts = engine.index(reader.option("since", json.dumps({repo: since})).load(), own, removed)
            return {"repo_id": repo, "commit_sha": commit, "full_scan": full, **counts}
        except Exception as e:
            self.record_failure(repo, repo, str(e))
            raise

    def index_root(self, folder: str, limit: int | None = None, include_worktrees: bool = False, max_seconds: float | None = None) -> Iterator[dict]:
        """Index every repository under a folder; one that fails gives an error row and leaves the others. The last row
        sums up."""
        found, skipped = git.discover(folder, include_worktrees)
        began, rows = time.monotonic(), []
        for repo in found[:limit]:
            if max_seconds is not None and time.monotonic() - began >= max_seconds:
                break
            try:
                rows.append({"event": "indexed", **self.index_repo(repo)})
            except Exception as e:
                rows.append({"event": "error", "repo_id": repo, "error": str(e)[:300]})
            yield rows[-1]
        errors = sum(r["event"] == "error" for r in rows)
        yield {"event": "summary", "discovered": len(found), "selected": len(rows), "indexed": len(rows) - errors, "errors": errors, "skipped_worktrees": skipped}

    def reindex(self, path: str | None = None) -> dict:
        """Index a repository again; without a path the only one there is."""
        if path is None:
            known = [r.repo_path for r in self.repos().select("repo_path").limit(2).collect()]
            if len(known) != 1:
                raise ValueError("a path is needed unless exactly one repository is indexed")
            path = known[0]
        return self.index_repo(path)

    def watch_once(self, path: str) -> dict:
        """Index a repository if its head moved or its last run failed: an event unchanged, indexed or error."""
        try:
            repo = git.root(path)
            commit = git.head(repo)
            state = self.repos().filter(F.col("repo_id") == repo).first()
            if state and state.last_commit_sha == commit and not state.error_count:
                return {"event": "unchanged", "repo_path": repo, "commit_sha": commit}
            return {"event": "indexed", **self.index_repo(repo)}
        except Exception as e:
            return {"event": "error", "repo_path": path, "error": str(e)[:300]}

    def watch(self, paths_: list[str], interval: float = 5.0, once: bool = False) -> Iterator[dict]:
        """Events of repositories, looked at in turn every interval."""
        while True:
            yield from (self.watch_once(p) for p in paths_)
            if once:
                return
            time.sleep(interval)

    def probed_heads(self) -> DataFrame:
        """(repo_id, head, dirty) of the repositories that can be probed from here."""
        rows = []
        for r in self.repos().select("repo_id", "repo_path").collect():  # a row for each repository
            try:
                rows.append((r.repo_id, git.head(r.repo_path), git.dirty(r.repo_path)))
            except Exception:  # not there, or no repository: stale
                pass
        return self.spark.createDataFrame(rows, "repo_id string, head string, dirty boolean")

    def _embedded(self, kept: DataFrame) -> DataFrame:
        if self.provider:
            return kept.join(embedding.embed(kept, "chunk_id", "content", self.provider), "chunk_id")
        made = vectors.hash_embeddings(kept, "chunk_id", "content", self.dims)
        return kept.join(made, "chunk_id", "left").withColumn("error", F.lit(None).cast("string"))

    def _features(self, chunks: DataFrame) -> DataFrame:
        ready = retrieval.prepared(chunks.withColumnRenamed("embedding", "vector"), [])
        return ready.drop("found", *retrieval.FIELDS, "symbol_kind", "symbol_line", "end_line")

    def _postings(self, chunks: DataFrame) -> DataFrame:
        return retrieval.field_postings(spread(chunks)).join(chunks.select("chunk_id", "repo_id", "path"), "chunk_id")

    def rebuild_text(self, force: bool = False) -> bool:
        """Make the stored full text anew if it was made by another version; whether it was."""
        state = self.state()
        if not force and state["meta"].get("fts_version") == FTS_VERSION or not state["parts"].get("chunks"):
            return False
        chunks = self.table("chunks", state)
        after = {**state, "meta": {**state["meta"], "fts_version": FTS_VERSION}, "parts": dict(state["parts"])}
        for name, rows in (("features", self._features(chunks)), ("postings", self._postings(chunks))):
            part = self._part(name, rows)
            after["parts"][name] = {i: part for i in state["parts"]["chunks"]}
            after["meta"][f"last_{name}"] = part
        self.manifest.commit(state, after)
        return True

    def backfill_vectors(self) -> int:
        """Embed what has no vector of the right size for this model; the number of chunks that got one."""
        state = self.state()
        chunks = self.table("chunks", state)
        if chunks is None:
            return 0
        bare = (F.col("embedding_model") == self.model) & (F.coalesce(F.size("embedding"), F.lit(-1)) != self.dims)
        todo = materialize(chunks.filter(bare).drop("embedding"), "bare")
        n = todo.count()
        if n:
            made = self._embedded(todo).drop("error")
            part = self._part("chunks", chunks.filter(~bare).unionByName(made.select(*chunks.columns)))
            after = {**state, "parts": {**state["parts"], "chunks": {i: part for i in state["parts"]["chunks"]}}, "meta": {**state["meta"], "last_chunks": part}}
            self.manifest.commit(state, after)
            self.rebuild_text(force=True)
        return n

    # -- removal -------------------------------------------------------------------------------------------------

    def _without(self, state: dict, ids: list[str]) -> dict:
        parts = {n: {i: p for i, p in held.items() if i not in ids} for n, held in state["parts"].items()}
        known = self.table("repos", state)
        tables = state["tables"] if known is None else {**state["tables"], "repos": self._whole("repos", known.filter(~F.col("repo_id").isin(ids)))}
        return {**state, "parts": parts, "tables": tables}

    def remove_repo(self, name: str) -> dict | None:
        """Remove a repository by id or path: what was removed, None if there is none of that name."""
        state = self.state()
        found = self.repos().filter((F.col("repo_id") == name) | (F.col("repo_path") == name)).select("repo_id", "repo_path").first()
        if not found:
            return None
        chunks = self.table("chunks", state)
        n = 0 if chunks is None else chunks.filter(F.col("repo_id") == found.repo_id).count()
        self.manifest.commit(state, self._without(state, [found.repo_id]))
        return {"repo_id": found.repo_id, "repo_path": found.repo_path, "chunks_removed": n}

    def prune(self, exists: Callable[[str], bool]) -> list[str]:
        """Remove the repositories whose path isn't there any more; their ids."""
        state = self.state()
        gone = sorted(r.repo_id for r in self.repos().select("repo_id", "repo_path").collect() if not exists(r.repo_path))
        if gone:
            self.manifest.commit(state, self._without(state, gone))
        return gone

    # -- queries -------------------------------------------------------------------------------------------------

    def _query_vectors(self, queries: DataFrame) -> DataFrame:
        """queries with query_vector. Vectors are kept under a keyed hash of the text, never the text; entries of another
        size are misses."""
        if not self.provider:
            made = vectors.hash_embeddings(queries, "query_id", "query_text", self.dims)
            return queries.join(made.withColumnRenamed("embedding", "query_vector"), "query_id")
        state = self.state()
        salt = state["meta"].get("salt") or secrets.token_hex(16)
        keyed = materialize(queries.withColumn("key", embedding.keyed_id("query_text", salt.encode())), "keyed")
        cache = self.table("query_cache", state)
        cache = cache if cache is not None else self.spark.createDataFrame([], CACHE)
        usable = cache.filter((F.col("model") == self.model) & (F.size("embedding") == self.dims))
        missing = keyed.join(usable, "key", "left_anti").dropDuplicates(["key"])
        made = materialize(embedding.embed(missing, "key", "query_text", self.provider).filter("error is null").select("key", F.lit(self.model).alias("model"), "embedding", F.current_timestamp().alias("at")), "vectors")
        if not made.isEmpty():
            all_rows = usable.unionByName(made).unionByName(cache.filter(F.col("model") != self.model))
            newest = all_rows.withColumn("n", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("at"), "key"))).filter(F.col("n") <= CACHE_ROWS).drop("n")
            after = {**state, "tables": {**state["tables"], "query_cache": self._whole("query_cache", newest)}, "meta": {**state["meta"], "salt": salt}}
            try:
                self.manifest.commit(state, after)
            except RuntimeError:  # another run committed: the entries are made again next time
                pass
        known = usable.select("key", "embedding").unionByName(made.select("key", "embedding"))
        return keyed.join(known.withColumnRenamed("embedding", "query_vector"), "key").drop("key")

    def _hits(self, queries: DataFrame, repo: str | None, path_prefix: str | None, language: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(queries with vectors, what scoring needs of all chunks, of those within the filters)."""
        self.rebuild_text()
        asked = materialize(self._query_vectors(queries), "queries")
        ready = retrieval.from_store(asked, self.table("postings"), self.table("features"))
        return asked, ready, retrieval.filtered(ready, self.model, repo, path_prefix, language)

    def covered(self) -> bool:
        chunks = self.table("chunks")
        mine = maintenance.coverage(chunks, self.dims).filter(F.col("embedding_model") == self.model) if chunks is not None else None
        return bool(mine is not None and [r for r in mine.collect() if r.complete])

    def search(self, queries: DataFrame, k: int = 10, repo: str | None = None, path_prefix: str | None = None, language: str | None = None, ranking: str = "current", exact_lists: bool = False, bonus: bool = False, debug: bool = False, union_threshold: int = retrieval.UNION_THRESHOLD) -> DataFrame:
        """The k best chunks of each query (query_id, query_text), with content, ranking_mode and candidate_path; queries
        that the fused ranking ("rrf") can't answer are answered by the current one, with the reason in
        rrf_disabled_reason. In an index of union_threshold chunks or more, all with vectors, queries are answered from
        the union of their nearest and their full-text chunks where that is large enough (`retrieval.union_plan`)."""
        if self.table("features") is None:
            raise ValueError("nothing is indexed")
        asked, ready, hits = self._hits(queries, repo, path_prefix, language)
        words = materialize(retrieval.bm25(asked, ready, within=hits, limit=retrieval.UNION_FTS_LIMIT if ranking == "rrf" else retrieval.FTS_LIMIT), "words")
        chunks = self.table("chunks")
        reasons = None
        fused = None
        if ranking == "rrf":
            near = retrieval.knn(asked.select("query_id", "query_vector"), hits.select("chunk_id", "path", "start_line", "vector"), retrieval.VECTOR_LIMIT, retrieval.TIES)
            lists = None
            if exact_lists and hits.limit(retrieval.EXACT_SCAN_LIMIT + 1).count() <= retrieval.EXACT_SCAN_LIMIT:
                some = [retrieval.exact_list(s, asked, hits, ready=hits) for s in ("path", "symbol", "lexical")]
                lists = some[0].unionByName(some[1]).unionByName(some[2])
            fused, reasons = retrieval.rrf_search(asked.withColumn("k", F.lit(k)), hits, "k", words, near, lists, bonus, self.covered())
            reasons = materialize(reasons, "reasons")
            asked = asked.join(reasons.filter("reason is not null").select("query_id"), "query_id", "left_semi")
            fused = fused.select("query_id", "chunk_id", F.col("rrf_score").alias("score"), "position", F.lit("rrf").alias("ranking_mode"))
        top = self._current(asked, ready, hits, words, k, bool(repo or path_prefix or language), union_threshold)
        top = top.select("query_id", "chunk_id", "score", "position", F.lit("current").alias("ranking_mode"), "candidate_path", *([*retrieval.WEIGHTS, "multiplier"] if debug else []))
        if fused is not None:
            top = top.unionByName(fused, allowMissingColumns=True).join(reasons.withColumnRenamed("reason", "rrf_disabled_reason"), "query_id", "left")
        shown = ["chunk_id", "repo_id", "repo_path", "path", "start_line", "end_line", "language", "symbol_name", "symbol_kind", "symbol_line", "symbol_confidence", "content"]
        return top.join(chunks.select(*shown), "chunk_id")

    def _current(self, asked: DataFrame, ready: DataFrame, hits: DataFrame, words: DataFrame, k: int, narrowed: bool, threshold: int) -> DataFrame:
        """The hybrid ranking: from all chunks within the filters, or from the candidates' union for the queries it holds for."""
        first = retrieval.minmax(words.filter(F.col("rank") <= retrieval.FTS_LIMIT), "bm25", "bm25_normal")
        whole = lambda q, w: retrieval.hybrid(q, hits, k, words=w, ready=hits).withColumn("candidate_path", F.lit("full_scan"))
        total = self.total_chunks()
        if total < threshold or not self.covered():
            return retrieval.diversified(whole(asked, first), F.lit(k), bypass=F.col("docs_query"))
        wide = retrieval.bm25(asked, ready, within=hits, limit=retrieval.UNION_FTS_LIMIT)
        wide = materialize(wide.limit(0) if narrowed else wide, "wide")  # within filters the union is of vectors alone
        near = materialize(retrieval.knn(asked.select("query_id", "query_vector"), hits.select("chunk_id", "path", "start_line", "vector"), retrieval.VECTOR_LIMIT, retrieval.TIES).select("query_id", "chunk_id"), "near")
        plan = materialize(retrieval.union_plan(asked.withColumn("k", F.lit(k)), near, wide, "k", total, True, threshold), "plan")
        chosen = asked.join(plan.filter("by_union").select("query_id"), "query_id", "left_semi")
        rest = asked.join(plan.filter("not by_union").select("query_id"), "query_id", "left_semi")
        candidates = near.unionByName(wide.select("query_id", "chunk_id")).distinct()
        some = retrieval.hybrid(chosen, hits, k, candidates=candidates, words=retrieval.minmax(wide, "bm25", "bm25_normal"), ready=hits)
        both = some.withColumn("candidate_path", F.lit("candidate_union")).unionByName(whole(rest, first))
        return retrieval.diversified(both, F.lit(k), bypass=F.col("docs_query"))

    def with_state(self, results: DataFrame, heads: DataFrame | None = None) -> DataFrame:
        """Results with is_stale and has_dirty_tracked_files of their repository; heads: (repo_id, head, dirty) as probed."""
        heads = heads if heads is not None else self.spark.createDataFrame([], "repo_id string, head string, dirty boolean")
        return maintenance.with_state(results, maintenance.repo_status(self.repos(), self.table("chunks").select("repo_id", "chunk_id"), heads))

    def symbol(self, names: DataFrame) -> DataFrame:
        """The best symbol of each name; for a name that no symbol holds, the best chunk of a search for it."""
        chunks = self.table("chunks").filter(F.col("embedding_model") == self.model)
        found = materialize(retrieval.symbol_lookup(names, chunks), "symbols")
        rest = names.select("name").distinct().join(found.select("name"), "name", "left_anti")
        rest = materialize(rest.select(F.xxhash64("name").alias("query_id"), F.col("name").alias("query_text")), "names")
        if rest.isEmpty():
            return found
        other = self.search(rest, 1).join(rest, "query_id")
        return found.unionByName(other.select(F.col("query_text").alias("name"), "chunk_id", "symbol_name", "path", "start_line", "score"))

    def expected_path(self, cases: DataFrame, **filters: str) -> DataFrame:
        """For each case (query_id, query_text, expected_path, expected_text): whether its path is indexed, the best of its
        chunks (one with the text before others, then by score) with the parts of its score, and that score's rank."""
        asked, ready, hits = self._hits(cases, filters.get("repo"), filters.get("path_prefix"), filters.get("language"))
        words = retrieval.minmax(retrieval.bm25(asked, ready, within=hits), "bm25", "bm25_normal")
        scored = materialize(retrieval.hybrid(asked, hits, "k", words=words, ready=hits, keep_all=True), "scored")
        content = self.table("chunks").select("chunk_id", "content")
        at = scored.join(cases.select("query_id", "expected_path", "expected_text"), "query_id").filter(F.col("path") == F.col("expected_path")).join(content, "chunk_id")
        hit = (F.coalesce("expected_text", F.lit("")) == "") | F.contains(F.lower("content"), F.lower("expected_text"))
        best = at.withColumn("text_match", F.coalesce(hit, F.lit(False))).groupBy("query_id").agg(F.max_by(F.struct("chunk_id", "score", "text_match", *retrieval.WEIGHTS, "multiplier"), F.struct("text_match", "score", F.col("chunk_id"))).alias("b"))
        ranks = scored.join(best.select("query_id", F.col("b.score").alias("best")), "query_id").groupBy("query_id").agg((F.count_if(F.col("score") > F.col("best")) + 1).alias("expected_rank"))
        out = cases.select("query_id", "expected_path").join(best, "query_id", "left").join(ranks, "query_id", "left")
        return out.select("query_id", "expected_path", F.col("b").isNotNull().alias("found"), "expected_rank", "b.*")

    def status(self) -> DataFrame:
        chunks = self.table("chunks")
        return chunks.groupBy("repo_id", "embedding_model").agg(F.count("*").alias("chunk_count"), F.count_if(F.size("embedding") == self.dims).alias("vectors"))

    def list_repos(self, heads: DataFrame | None = None) -> DataFrame:
        """Repositories in order with their chunks and staleness; heads: (repo_id, head, dirty) as probed."""
        heads = heads if heads is not None else self.spark.createDataFrame([], "repo_id string, head string, dirty boolean")
        chunks = self.table("chunks")
        chunks = chunks.select("repo_id", "chunk_id") if chunks is not None else self.spark.createDataFrame([], "repo_id string, chunk_id string")
        return maintenance.repo_status(self.repos(), chunks, heads).orderBy("repo_id")

    def total_chunks(self) -> int:
        """The chunks that the state of the files counts; 0 without any."""
        files = self.table("indexed_files")
        return 0 if files is None else files.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("n")).first().n
