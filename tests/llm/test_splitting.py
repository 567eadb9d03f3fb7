import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseam.llm import splitting as sp

PLANS = [sp.Plan(limit=100, overlap=20, range=500, look=32), sp.Plan(limit=60, overlap=0, range=200, look=16), sp.Plan(limit=100, overlap=30, range=1 << 16, look=32)]


def pieces(data: bytes, plan: sp.Plan):
    halo = plan.look + plan.overlap + 4
    rows = []
    for no in range((len(data) - 1) // plan.range + 1):
        offset = max(0, no * plan.range - halo)
        rows.append(("x", 0, no, len(data), offset, data[offset : no * plan.range + plan.range + plan.limit + plan.look]))
    return [r for b in sp._emit(iter(rows), plan) for r in b.to_pylist() if r["piece"] is not None]


@pytest.mark.parametrize("plan", PLANS)
@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["def f(x):\n", "word ", "\n\n", "Sentence. ", "é", "日本語。", "x" * 70, "\n", "🔥", "class A:\n"]), min_size=1, max_size=200))
def test_pieces_are_the_text(plan, parts):
    data = "".join(parts).encode()
    at = 0
    for p in pieces(data, plan):
        assert p["start_byte"] <= at < p["end_byte"] and at - p["start_byte"] <= plan.overlap
        assert p["end_byte"] - p["start_byte"] <= plan.limit
        assert data[p["start_byte"] : p["end_byte"]].decode() == p["text"]
        at = p["end_byte"]
    assert at == len(data)


def test_preference():
    text = "a" * 40 + ". " + "b" * 10 + "\n" + "c" * 20 + "\n\n" + "d d d d d d d d d\n" + "e" * 60
    first = pieces(text.encode(), PLANS[2])[0]
    assert first["boundary"] == "paragraph" and first["text"].endswith("\n\n")
    with_def = "x = 1\n" * 5 + "def f():\n    pass\n" + "y = 2\n\n" + "z" * 90
    assert pieces(with_def.encode(), PLANS[2])[0]["boundary"] == "declaration"


def test_table(spark):
    long = "".join(f"line {i}\n" for i in range(40))
    rows = [("a", long), ("a", long), ("b", "short"), ("c", None), ("d", ""), (None, long), ("e", "y" * 100_000)]
    df = spark.createDataFrame(rows, "id string, text string").selectExpr("*", "1 as range_no", "2 as line")
    plan = sp.Plan(limit=100, overlap=20, range=150, look=16)
    got = sp.split_texts(df, plan).orderBy("id", "piece_no").collect()
    assert {r.id for r in got} == {"a", "e"}
    a = [r for r in got if r.id == "a"]
    assert [r.piece_no for r in a] == list(range(len(a)))
    whole = long.split("\n")
    for r in a:
        assert r.text.rstrip("\n").split("\n")[0] in whole[r.first_line]
        assert r.text.rstrip("\n").split("\n")[-1] in whole[r.last_line]
    assert sum(r.end_byte - r.start_byte for r in got if r.id == "e") >= 100_000
    assert sp.split_texts(df.limit(0), plan).count() == 0


def test_texts_under_one_id(spark):
    texts = ["".join(f"{word} {i}\n" for i in range(60)) for word in ("one", "two", "three")]
    df = spark.createDataFrame([("a", t) for t in texts * 3] + [("b", texts[0])], "id string, text string").repartition(5)
    plan = sp.Plan(limit=100, overlap=20, range=150, look=16)
    alone = {t: [(r.piece_no, r.first_line, r.text) for r in sp.split_texts(spark.createDataFrame([("x", t)], "id string, text string"), plan).orderBy("piece_no").collect()] for t in texts}
    got = [(r.piece_no, r.first_line, r.text) for r in sp.split_texts(df, plan).filter("id = 'a'").orderBy("piece_no").collect()]
    assert got in alone.values()
    assert [(r.piece_no, r.first_line, r.text) for r in sp.split_texts(df, plan).filter("id = 'b'").orderBy("piece_no").collect()] == alone[texts[0]]


def test_files_by_ranges(spark, tmp_path):
    text = "".join(f"row {i} é\n" for i in range(3000))
    (tmp_path / "big.txt").write_text(text, encoding="utf-8")
    (tmp_path / "small.txt").write_text("x")
    df = spark.createDataFrame([(f"file://{tmp_path}/big.txt",), (f"file://{tmp_path}/small.txt",), (None,)], "path string")
    plan = sp.Plan(limit=1000, overlap=50, range=4096, look=64)
    files = [(r.start_byte, r.text) for r in sp.split_files(df, plan).orderBy("piece_no").collect()]
    texts = [(r.start_byte, r.text) for r in sp.split_texts(spark.createDataFrame([("x", text)], "id string, text string"), plan).orderBy("piece_no").collect()]
    assert files == texts and len(files) > 30
