import os
import subprocess
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseam.llm import lexicon as lx
from lodeseam.llm import tokens

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=lx.read_ranks(ranks), special_tokens={})


@pytest.fixture(scope="module")
def lexicon(tmp_path_factory, ranks):
    path = tmp_path_factory.mktemp("lex") / "lexicon.bin"
    words = [b"the", b" the", b" then", b"them", b"\n", b" ", "é".encode(), b"def", b"a", b"ab", b"abc", b" 12"]
    path.write_bytes(lx.pack_lexicon(words, [lx.merger(ranks)(w) for w in words]))
    return lx.Lexicon(str(path))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab1 '\n\tstre'lvd.é日"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=4))
def test_equals_the_public_tokenizer(ranks, reference, lexicon, texts):
    flat, n = lx.encode_texts(texts, lexicon, lx.merger(ranks))
    ends = np.concatenate([[0], np.cumsum(n)])
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [reference.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), min_size=1, max_size=60), st.lists(st.binary(min_size=1, max_size=7), max_size=30))
def test_automaton_ranks_words(tmp_path_factory, words, others):
    path = tmp_path_factory.mktemp("a") / "lexicon.bin"
    ordered = sorted(words)
    path.write_bytes(lx.pack_lexicon(ordered, [[i] for i in range(len(ordered))]))
    asked = ordered + others
    buf = np.frombuffer(b"".join(asked), np.uint8)
    size = np.array([len(w) for w in asked])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    assert lx.Lexicon(str(path)).ranks(buf, begin, size).tolist() == [ordered.index(w) if w in words else -1 for w in asked]


def test_automaton_is_minimal():
    made = lx.compile_words(sorted(a + b for a in (b"x", b"y", b"z") for b in (b"1", b"2", b"12")))
    assert len(made["final"]) == 4  # start, after a letter, after 1, end


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=30))
def test_own_merges_equal_compiled_ones(ranks, word):
    assert lx.merge_word(word, lx.read_ranks(ranks)) == list(lx.merger(ranks)(word))


def test_table(spark, reference):
    long = "word " * 300_000
    rows = [(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|> is text"), (5, "  \n"), (6, long), (6, long), (7, "\r\n\u0301\x00x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as ids", "1 as n_tokens", "2 as key")
    got = tokens.encode(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    assert all(list(r.ids) == reference.encode_ordinary(texts[r.doc_id] or "") for r in got)
    counts = {r.doc_id: r.n_tokens for r in tokens.encode(df, "doc_id", "text", ids=False, words=3).collect()}
    assert counts == {r.doc_id: len(r.ids) for r in got}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def test_whole_table(spark, sf, reference):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    from lodeseam.llm.queries import p8_ids

    got = {r.doc_id: list(r.ids) for r in p8_ids(spark, sf).collect()}
    assert got == {k: reference.encode_ordinary(t or "") for k, t in docs.items()}


def test_frequent_words(spark):
    rows = [(bytes([97 + i % 26]) * (1 + i // 26), 2 + i) for i in range(200)]
    counts = spark.createDataFrame(rows, "word binary, n long").repartition(7)
    for most in (0, 1, 50, 199, 200, 500):
        got = tokens.frequent_words(counts, most)
        assert len(got) <= most and len(set(got)) == len(got)
        best = [w for w, _ in sorted(rows, key=lambda r: -r[1])[: len(got)]]
        assert set(got) == set(best) and (most < 200 or len(got) == 200)


CLUSTER = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", sys.argv[2]).config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
from lodeseam.llm.queries import p8_ids, p9_mix, p9_shares
print("ids", p8_ids(spark, sys.argv[1]).selectExpr("sum(size(ids))").first()[0])
print("uses", p9_mix(spark, sys.argv[1]).count(), p9_shares(spark, sys.argv[1]).selectExpr("sum(uses)").first()[0])
"""


@pytest.mark.parametrize("scheme", ["file://", ""])
def test_on_executors_of_their_own(sf, reference, spark, tmp_path, scheme):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = subprocess.run([sys.executable, "-c", CLUSTER, sf, f"{scheme}{tmp_path}"], cwd=root, capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": root})
    assert run.returncode == 0, run.stderr[-2000:]
    out = dict(line.split(" ", 1) for line in run.stdout.splitlines() if line.startswith(("ids", "uses")))
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert int(out["ids"]) == sum(len(reference.encode_ordinary(t)) for t in texts)
    assert len(set(out["uses"].split())) == 1
