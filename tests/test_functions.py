import hashlib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseam.functions import paths, text, vectors
from lodeseam.operators import chunker


def model_tokens(t):
    out = []
    for word in re.findall(text.WORD, t):
        for part in word.split("_"):
            out += [p.lower() for p in re.split(r"(?<!^)(?=[A-Z])", part) if p]
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAB_19 .é-\nK"), max_size=25), min_size=20, max_size=40))
def test_tokens_equal_the_model(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", text.tokens("t").alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: model_tokens(t) for i, t in enumerate(texts)}


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(values[n], (str, type(None))) else 'array<double>'}" for n in names))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("t,expected", [("def retryRequest(max_attempts):", ["def", "retry", "request", "max", "attempts"]), ("HTTPServer2", ["h", "t", "t", "p", "server2"]), ("2abc 9_x", ["2", "abc", "9", "x"]), (None, []), ("", [])])
def test_tokens(spark, t, expected):
    assert one(spark, text.tokens("t"), t=t) == expected


def test_expansion_and_terms(spark):
    assert one(spark, text.expanded("q"), q="retry handler config")[:3] == ["retry", "handler", "config"]
    assert {"backoff", "endpoint", "setting"} <= set(one(spark, text.expanded("q"), q="retry handler config"))
    assert one(spark, text.query_terms("q"), q="where is the retry of it")[0] == "retry"
    assert len(one(spark, text.query_terms("q"), q=" ".join(f"word{i}" for i in range(30)))) == 16


@pytest.mark.parametrize("t", ["a\nb\r\nc\rd\x0be\x85f g", "x\n", "\n", "", "a", None, "a\n\n"])
def test_lines(spark, t):
    assert one(spark, text.lines("t"), t=t) == (t or "").splitlines()


@pytest.mark.parametrize("n,most,overlap", [(5, 3, 1), (0, 3, 1), (80, 80, 10), (81, 80, 10), (151, 80, 10), (3, 3, 1)])
def test_windows(spark, n, most, overlap):
    lines = [str(i) for i in range(1, n + 1)]
    df = spark.createDataFrame([(lines,)], "l array<string>")
    got = [(w.start_line, w.end_line, w.content) for w in df.select(chunker.windows(F.col("l"), most, overlap).alias("w")).first().w]
    want, start = [], 0
    while start < n:
        end = min(start + most, n)
        want.append((start + 1, end, "\n".join(lines[start:end])))
        if end == n:
            break
        start += most - overlap
    assert got == want


def test_symbols(spark):
    lines = ["// function fake() {", 'const s = "function other() {"', "function realHandler() {", "class A:", "  def b(self):", "type T struct {"]
    df = spark.createDataFrame([(lines,)], "l array<string>").select(chunker.regex_symbols(F.col("l")).alias("s"))
    got = df.first().s
    assert [(s.name, s.kind, s.line) for s in got] == [("realHandler", "function", 3), ("A", "class", 4), ("b", "function", 5), ("T", "type", 6)]
    near = lambda a, b: df.select(chunker.nearest_symbol(F.col("s"), F.lit(a), F.lit(b)).alias("n")).first().n
    assert near(4, 5).name == "A" and near(7, 9).name == "T" and near(1, 2) is None


@pytest.mark.parametrize(
    "path,line,name,kind",
    [("a.py", "def load(x):", "load", "function"), ("a.js", "function load(x) {", "load", "function"), ("a.ts", "interface Load {", "Load", "interface"), ("a.go", "func load(x int) int {", "load", "function"), ("a.java", "class Load {", "Load", "class")],
)
def test_symbols_by_expression_are_chunks(spark, path, line, name, kind):
    lines = ["", "", line, *[f"    x{i} = {i}" for i in range(100)], line, "    y = 1"]
    files = spark.createDataFrame([("r", "/r", path, "\n".join(lines)), ("r", "/r", "empty" + path, ""), ("r", "/r", "null" + path, None)], "repo_id string, repo_path string, path string, content string")
    got = [r for r in chunker.chunk_files(files).collect() if r.symbol_confidence == "regex" and r.start_line == r.symbol_line]
    want = [(3, 82, "\n".join(lines[2:82])), (104, 105, "\n".join(lines[103:105]))]
    assert sorted((r.start_line, r.end_line, r.content) for r in got) == want
    assert {(r.path, r.symbol_name, r.symbol_kind) for r in got} == {(path, name, kind)}
    windows = sorted((r.start_line, r.end_line) for r in chunker.chunk_files(files).collect() if r.symbol_confidence == "regex" and r.start_line != r.symbol_line)
    assert windows == [(1, 80), (71, 105)]


def test_long_python_symbols_are_left_out(spark):
    body = lambda n: "".join(f"    x{i} = {i}\n" for i in range(n))
    source = "@d\ndef fits():\n" + body(79) + "def long():\n" + body(80)
    files = spark.createDataFrame([("r", "a.py", source)], "repo_id string, path string, content string")
    assert [(r.symbol_name, r.start_line, r.end_line) for r in chunker.syntax_chunks(files).collect()] == [("fits", 1, 81)]


def test_python_symbols():
    got = chunker.python_symbols("class S:\n    @d\n    def h(self):\n        pass\n\ndef f():\n    pass\n")
    assert got == [("S", "class", 1, 4, 1), ("h", "function", 2, 4, 3), ("f", "function", 6, 7, 6)]
    assert chunker.python_symbols("def broken(:") == []


def test_chunk_id(spark):
    df = spark.createDataFrame([("r", "p", 1, 2, None, "parser", "x")], "repo_id string, path string, start_line int, end_line int, symbol_name string, symbol_confidence string, content string")
    want = hashlib.sha256("\0".join(["r", "p", "1", "2", "", "parser", hashlib.sha256(b"x").hexdigest()]).encode()).hexdigest()
    assert df.select(chunker.chunk_id().alias("i")).first().i == want


@pytest.mark.parametrize("content,line,start,end,kept", [("x", None, 1, 1, False), ("def tiny", 1, 1, 1, True), ("def tiny", 9, 1, 1, False), ("y" * 50, None, 1, 1, True), (" \n\t" * 40, 1, 1, 1, False)])
def test_indexable(spark, content, line, start, end, kept):
    df = spark.createDataFrame([(content, line, start, end)], "content string, symbol_line int, start_line int, end_line int")
    assert df.select(chunker.indexable().alias("k")).first().k is kept


@pytest.mark.parametrize("path,value", [(".env", True), ("a/node_modules/b.js", True), ("x.pb.go", True), (".zbrain/a.md", True), ("d.parquet", True), ("d.jsonl", True), ("src/app.py", False), ("LICENSE", False), ("a/dist/x.js", True), ("uv.lock", True)])
def test_skip(spark, path, value):
    assert one(spark, paths.skip("p"), p=path) is value


@pytest.mark.parametrize("path,value", [("src/a.spec.ts", True), ("libs/api/x.ts", True), ("libs/api/keep.spec.ts", False), ("a/fixtures/x.py", True), ("src/a.ts", False)])
def test_ignore(spark, path, value):
    rules = paths.ignore_rules("*.spec.ts\nlibs/api/**\nfixtures/\n!libs/api/keep.spec.ts\n# note\n")
    assert one(spark, paths.ignored("p", rules), p=path) is value


@pytest.mark.parametrize("path,value", [("src/app.py", "python"), ("README.md", "markdown"), ("unknown.xyz", "text"), ("a.b/c", "text")])
def test_language(spark, path, value):
    assert one(spark, paths.language("p"), p=path) == value


@pytest.mark.parametrize("url,value", [("https://u:p@git.example/a.git?x=1#y", "https://git.example/a.git"), ("git@git.example:a/b.git", "git@git.example:a/b.git"), ("TOKEN@gitlab.com:acme/repo.git", "gitlab.com:acme/repo.git"), ("https://git.example:8443/a", "https://git.example:8443/a"), ("", "")])
def test_remote(spark, url, value):
    assert one(spark, paths.sanitized_remote("u"), u=url) == value


def test_intent(spark):
    assert one(spark, paths.wants_docs("q"), q="handler config docs") is True
    assert one(spark, paths.wants_docs("q"), q="where is handler implemented") is False


def test_vectors(spark):
    assert one(spark, vectors.cosine("a", "b"), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, vectors.cosine("a", "b"), a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    assert one(spark, vectors.normalize("a"), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.normalize("a"), a=[0.0, 0.0]) == [0.0, 0.0]
    assert [vectors.blake_place(t, 256) for t in ("retry", "request", "max")] == [(46, -1), (72, 1), (168, 1)]


def test_hash_embedding(spark):
    df = spark.createDataFrame([(1, "retry request retry"), (2, ""), (3, None)], "id long, t string")
    got = {r.id: r.embedding for r in vectors.hash_embeddings(df, "id", "t", 256).collect()}
    assert got[1][46] == pytest.approx(-2 / math.sqrt(5)) and got[1][72] == pytest.approx(1 / math.sqrt(5))
    assert got[2] == got[3] == [0.0] * 256
