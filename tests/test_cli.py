import hashlib
import hmac
import io
import json
import subprocess

import pytest

from lodeseam import cli
from lodeseam.operators import embedding


def run(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t.example", *args], check=True, capture_output=True)


def test_commands(spark, tmp_path, capsys):
    repo = tmp_path / "root" / "one"
    repo.mkdir(parents=True)
    run(repo, "init", "-q", "-b", "main")
    (repo / "retry.py").write_text("def handle_retry():\n    return 'retry the request after a pause of some length'\n")
    (repo / "other.py").write_text("def other_thing():\n    return 'nothing of the kind, but it is long enough as well'\n")
    run(repo, "add", ".")
    run(repo, "commit", "-qm", "first")
    call = lambda *a: cli.run(cli.parser().parse_args(["--db", str(tmp_path / "db"), *a]), spark)
    assert call("index-root", str(tmp_path / "root")) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert lines[0]["files_changed"] == 2 and lines[0]["full_scan"] and lines[-1] == {"event": "summary", "discovered": 1, "selected": 1, "indexed": 1, "errors": 0, "skipped_worktrees": 0}
    assert call("query", "handle retry", "-k", "1") == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["path"] == "retry.py"
    (tmp_path / "g.jsonl").write_text(json.dumps({"id": "1", "query": "handle retry", "expected_path": "retry.py"}))
    assert call("eval", str(tmp_path / "g.jsonl"), "--fail-under", "0.9") == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["recall_at_k"] == 1.0


def last(capsys):
    return json.loads([x for x in capsys.readouterr().out.splitlines() if x.startswith(("{", "n"))][-1])


def test_watch_hooks_and_pilot(spark, tmp_path, capsys):
    repo = tmp_path / "one"
    repo.mkdir()
    run(repo, "init", "-q", "-b", "main")
    long = "def {}():\n    return 'some text that is long enough to be indexed as a chunk'\n"
    (repo / "a.py").write_text(long.format("first_thing"))
    (repo / "b.py").write_text(long.format("second_thing"))
    (repo / "c.py").write_text(long.format("third_thing"))
    run(repo, "add", ".")
    run(repo, "commit", "-qm", "first")
    call = lambda *a: cli.run(cli.parser().parse_args(["--db", str(tmp_path / "db"), *a]), spark)
    assert call("watch", str(repo), "--once") == 0 and last(capsys)["event"] == "indexed"
    assert call("watch", "--once") == 0 and last(capsys)["event"] == "unchanged"
    (repo / "a.py").write_text(long.format("changed_thing"))
    (repo / ".lodeseamignore").write_text("")
    run(repo, "rm", "-q", "b.py")
    run(repo, "add", "-A")
    run(repo, "commit", "-qm", "second")
    assert call("watch", "--once") == 0
    got = last(capsys)
    assert (got["event"], got["full_scan"], got["files_changed"], got["files_removed"], got["files_same"]) == ("indexed", False, 2, 1, 0)  # the ignore file is a file as well
    # an ignore file that is committed later changes what every file is indexed by
    (repo / ".lodeseamignore").write_text("c.py\n")
    run(repo, "commit", "-qam", "third")
    assert call("reindex") == 0
    got = last(capsys)
    assert got["full_scan"] and (got["files_ignored"], got["files_removed"], got["files_changed"]) == (1, 1, 2)
    assert call("query", "changed thing", "--log", str(tmp_path / "log.jsonl"), "--ranking", "rrf") == 0
    found = last(capsys)
    assert found["path"] == "a.py" and not found["is_stale"] and not found["has_dirty_tracked_files"]
    from lodeseam import tools
    from lodeseam.engine import Engine

    asked = [{"jsonrpc": "2.0", "id": 1, "method": "tools/list"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/call", "params": {"name": "search_code", "arguments": {"query": "changed thing", "k": 1}}}, {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "get_symbol", "arguments": {"name": "changed_thing"}}}, {"jsonrpc": "2.0", "id": 4, "method": "nothing"}, {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "reindex", "arguments": {"path": "/none"}}}]
    sink = io.StringIO()
    tools.serve(Engine(spark, f"file://{tmp_path}/db"), io.StringIO("\n".join(map(json.dumps, asked))), sink)
    answers = {a["id"]: a for a in map(json.loads, sink.getvalue().splitlines())}
    assert set(answers) == {1, 2, 3, 4, 5} and len(answers[1]["result"]["tools"]) == 4 and "error" in answers[4] and answers[5]["result"]["isError"]
    assert json.loads(answers[2]["result"]["content"][0]["text"])[0]["path"] == "a.py"
    assert "def changed_thing" in json.loads(answers[3]["result"]["content"][0]["text"])["definition"]
    assert call("install-hooks", str(repo)) == 0 and last(capsys)["installed"] == 1
    assert call("doctor") == 0 and last(capsys)["hooks"]["repos_checked"] == 1
    fields = json.dumps({"engineer": "e", "task": "find it"})
    assert call("pilot", "start-task", "--log", str(tmp_path / "log.jsonl"), "--fields", fields) == 0
    begun = last(capsys)
    assert begun["task_length"] == 7 and "find" not in json.dumps(begun)
    assert (tmp_path / "log.jsonl").stat().st_mode & 0o077 == 0
    assert call("report", str(tmp_path / "log.jsonl")) == 0
    report = last(capsys)
    assert (report["events"], report["search_count"], report["zero_result_rate"]) == (2, 1, 0.0)
    assert call("eval-add", str(tmp_path / "g.jsonl"), json.dumps({"id": "1", "query": "changed thing", "expected_path": "a.py"})) == 0
    with pytest.raises(ValueError, match="secret"):
        call("eval-add", str(tmp_path / "g.jsonl"), json.dumps({"id": "2", "query": "AKIA" + "A" * 16}))
    assert call("eval", str(tmp_path / "g.jsonl"), "--fail-under", "0.9") == 0
    (tmp_path / "bad.jsonl").write_text('# cases\n{"id": "1", "query": "x", "other": 1}\n')
    with pytest.raises(ValueError, match="line 2: unknown field other"):
        call("eval", str(tmp_path / "bad.jsonl"))
    capsys.readouterr()
    assert call("remove-repo", str(repo)) == 0 and last(capsys)["chunks_removed"] > 0
    assert call("remove-repo", str(repo)) == 1
    capsys.readouterr()
    assert call("watch", str(tmp_path / "none"), "--once") == 1 and last(capsys)["event"] == "error"


def test_providers(spark):
    class Flaky:
        model_id, dimensions = "flaky", 2

        def embed_batch(self, texts):
            if len(texts) > 1 or texts == ["bad"]:
                raise ValueError("no")
            return [[3.0, 4.0]]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, " "), (4, None)], "id long, t string").coalesce(1)
    got = {r.id: (r.embedding, r.error) for r in embedding.embed(df, "id", "t", Flaky()).collect()}
    assert got == {1: ([0.6, 0.8], None), 2: (None, "no"), 3: ([0.0, 0.0], None), 4: ([0.0, 0.0], None)}
    from lodeseam.functions.vectors import hash_embeddings

    one = {r.id: r.embedding for r in embedding.embed(df, "id", "t", embedding.HashProvider(32)).collect()}
    two = {r.id: r.embedding for r in hash_embeddings(df, "id", "t", 32).collect()}
    assert all(one[k] == pytest.approx(two[k]) for k in one)


def test_keyed_ids(spark):
    df = spark.createDataFrame([("x",), (None,)], "t string")
    got = [r.p for r in df.select(embedding.text_payload("t", b"salt").alias("p")).collect()]
    assert got[0].length == 1 and got[0].id == hmac.new(b"salt", b"x", hashlib.sha256).hexdigest()[:16] and got[0].raw is None and got[1] is None


def test_http_providers(monkeypatch):
    import http.server
    import threading

    from lodeseam.operators import providers

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization")))
            code, out = 200, {}
            if self.path == "/old/api/embed":
                code = 404
            elif self.path == "/v1/embeddings" and len([p for p, _ in seen if p == self.path]) == 1:
                code = 429
            elif self.path == "/bad/embeddings":
                code = 400
            elif self.path.endswith("/api/embed"):
                out = {"embeddings": [[1.0, float(len(t))] for t in body["input"]]}
            elif self.path.endswith("/api/embeddings"):
                out = {"embedding": [2.0, float(len(body["prompt"]))]}
            else:
                out = {"data": [{"index": i, "embedding": [3.0, float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}
            self.send_response(code)
            self.send_header("Retry-After", "0")
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    assert providers.OllamaProvider("m", 2, url).embed_batch(["a", "bb"]) == [[1.0, 1.0], [1.0, 2.0]]
    assert providers.OllamaProvider("m", 2, url + "/old").embed_batch(["a", "bb"]) == [[2.0, 1.0], [2.0, 2.0]]
    assert providers.OpenAIProvider("m", 2, url + "/v1", base=0.01).embed_batch(["a", "bb"]) == [[3.0, 1.0], [3.0, 2.0]]
    assert ("/v1/embeddings", "Bearer k") in seen and len([p for p, _ in seen if p == "/v1/embeddings"]) == 2
    with pytest.raises(RuntimeError, match="400"):
        providers.OpenAIProvider("m", 2, url + "/bad").embed_batch(["a"])
    assert providers.choose("auto", url="http://127.0.0.1:9").model_id.startswith("hash") and providers.choose("ollama", url=url).model_id == "ollama:mxbai-embed-large"
    assert [providers.pause(n, None, 0.5) for n in range(3)] == [0.5, 1.0, 2.0] and providers.pause(5, "3") == 3.0
    with pytest.raises(ValueError):
        providers.choose("none")
    server.shutdown()
