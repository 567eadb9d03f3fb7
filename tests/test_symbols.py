import time

import pytest

from lodeseam.operators import chunker
from lodeseam.operators.symbols import blanked, find_symbols

CASES = [
    ("typescript", "export function retryRequest() { return true; }\n", [("retryRequest", "function", 1, 1)]),
    ("typescript", "export const retryRequest = () => true;\nconst x = 5;\nconst y = (a + b) * 2;\n", [("retryRequest", "function", 1, 1)]),
    ("typescript", "export function RetryButton() { return <button />; }\n", [("RetryButton", "function", 1, 1)]),
    ("typescript", "type A = {\n  b: string;\n};\ninterface I { x(): void }\nenum E { a }\n", [("A", "type", 1, 3), ("I", "interface", 4, 4), ("E", "enum", 5, 5)]),
    ("go", "package main\nfunc RetryRequest() bool { return true }\ntype A struct {\n x int\n}\ntype B int\nfunc (a *A) Do() {\n}\n", [("RetryRequest", "function", 2, 2), ("A", "type", 3, 5), ("B", "type", 6, 6), ("Do", "method", 7, 8)]),
    ("java", "class RetryService { void retryRequest() {} }\n", [("RetryService", "class", 1, 1), ("retryRequest", "method", 1, 1)]),
    ("java", "public class A {\n  @Override\n  public int get(int a) throws X {\n    if (a) { return b(c); }\n    return new C() { };\n  }\n}\n", [("A", "class", 1, 7), ("get", "method", 2, 6)]),
    ("rust", "pub fn retry_request() -> bool { true }\nstruct P(i32);\nenum Q { A, B }\n", [("retry_request", "function", 1, 1), ("P", "struct", 2, 2), ("Q", "enum", 3, 3)]),
    ("cpp", "int retry_request() { return 1; }\nclass Later;\nstruct S {\n  int a;\n};\n", [("retry_request", "function", 1, 1), ("S", "struct", 3, 5)]),
    ("cpp", "Result retry_request() { return Result{}; }\n", [("retry_request", "function", 1, 1)]),
    ("sql", "CREATE TABLE retry_events (id INT);\ncreate view `v` as select ';'\nfrom x;\n", [("retry_events", "table", 1, 1), ("v", "view", 2, 3)]),
    ("javascript", "class A {\n  constructor(x) { this.x = x }\n  async run(a) {\n    for (const i of a) { go(i) }\n  }\n}\nconst f = async function () {\n  return 1\n}\n", [("A", "class", 1, 6), ("constructor", "method", 2, 2), ("run", "method", 3, 5), ("f", "function", 7, 9)]),
    ("javascript", "var s = \"function no() {}\"; // function nope() {}\n/* class Never {} */\n", []),
    ("javascript", "function broken( {\n", []),
    ("javascript", "function cut() {\n  if (x) {\n", []),
    ("python", "def f(): pass\n", []),
    ("java", "", []),
]


@pytest.mark.parametrize("language,content,want", CASES)
def test_symbols(language, content, want):
    assert sorted(map(tuple, find_symbols(content, language))) == sorted(want)


def test_blanked_keeps_lines():
    text = "a 'x\\'y' b /* c\nd */ `e\n${f}` // g\nh"
    out = blanked(text, "javascript")
    assert len(out) == len(text) and out.count("\n") == text.count("\n") and out.split() == ["a", "b", "h"]


@pytest.mark.parametrize("text", ["{" * 200_000, "a(" * 150_000, "class A " * 80_000, "function a(" * 60_000, "class A{" * 40_000 + "b(){}" * 20_000, "const a = (" * 80_000, "type A " * 80_000, '"' * 200_001, "/*" * 100_000])
@pytest.mark.parametrize("language", ["javascript", "java", "cpp", "go"])
def test_linear(text, language):
    began = time.perf_counter()
    find_symbols(text, language)
    assert time.perf_counter() - began < 3


def test_chunks(spark):
    rows = [("r", "/r", "App.java", "class RetryService { void retryRequest() {} }\n"), ("r", "/r", "a.go", "package p\n\nfunc Long() {\n" + "\tx()\n" * 100 + "}\n"), ("r", "/r", "b.js", "not code at all\n"), ("r", "/r", "c.rb", "def thing(a)\nend\n"), ("r", "/r", "n.ts", None)]
    chunks = chunker.chunk_files(spark.createDataFrame(rows, "repo_id string, repo_path string, path string, content string")).collect()
    of = lambda p, c: {(r.symbol_name, r.start_line, r.end_line) for r in chunks if r.path == p and r.symbol_confidence == c}
    assert {("RetryService", 1, 1), ("retryRequest", 1, 1)} <= of("App.java", "parser") and not of("App.java", "regex")
    # a declaration of more than 80 lines is left to the windows, which bear its name
    assert of("a.go", "parser") == {("Long", 1, 80), ("Long", 71, 104)}
    assert of("b.js", "parser") == of("b.js", "regex") == set() and [r for r in chunks if r.path == "b.js"]
    assert of("c.rb", "regex") == {("thing", 1, 2)} and not [r for r in chunks if r.path == "n.ts"]
