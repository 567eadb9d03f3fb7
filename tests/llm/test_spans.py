import itertools
import random

import numpy as np
import pytest

from lodeseam.llm import spans

N = 40


def texts():
    rng = random.Random(5)
    letters = "abcdefgh é日🔥"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [word(n) for n in (39, 40, 41, 60, 100, 300)]
    out = [word(rng.randint(0, 150)) for _ in range(30)]
    for s in shared:
        for _ in range(3):
            out.append(word(rng.randint(0, 50)) + s + word(rng.randint(0, 50)))
    out += [out[-1], out[-1], "x" * 100, "x" * 90, None, "", "   ", word(20) + "x" * 39]
    return list(enumerate(out)) + [(0, out[0])]


def brute(docs):
    sets = {k: {t[i : i + N] for i in range(len(t) - N + 1)} for k, t in docs if t}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b]}


@pytest.mark.parametrize("hot,held,piece", [(spans.HOT, spans.HELD, spans.PIECE_BITS), (0, spans.HELD, spans.PIECE_BITS), (4, 0, 1 << 12), (1_000_000, 0, 1 << 12)])
def test_pairs_equal_brute_force(spark, monkeypatch, hot, held, piece):
    monkeypatch.setattr(spans, "PIECE_BITS", piece)
    docs = texts()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as rep", "2 as h", "3 as key")
    shared = spans.shared_spans(df, min_chars=N, hot=hot)
    pairs = [(r.doc_a, r.doc_b) for r in spans.document_pairs(shared).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(docs)
    by_key = dict(docs)
    for r in shared.spans.collect():
        a, b = by_key[r.doc_a], by_key[r.doc_b]
        assert r.length >= N and a[r.start_a : r.start_a + r.length] == b[r.start_b : r.start_b + r.length]
        assert r.start_a == 0 or r.start_b == 0 or a[r.start_a - 1] != b[r.start_b - 1]
        end = (r.start_a + r.length, r.start_b + r.length)
        assert end[0] == len(a) or end[1] == len(b) or a[end[0]] != b[end[1]]
    got = {r.doc_id: r for r in spans.shared_fraction(df, shared).collect()}
    known = {k: t for k, t in docs if t}
    for k, t in known.items():
        others = [set(o[i : i + N] for i in range(len(o) - N + 1)) for j, o in known.items() if j != k]
        inside = [any(t[i : i + N] in o for o in others) for i in range(max(0, len(t) - N + 1))]
        covered = sum(any(inside[max(0, c - N + 1) : c + 1]) for c in range(len(t)))
        assert got[k].shared_chars == covered, k
        mine = {t[i : i + N] for i in range(len(t) - N + 1)}
        partners = {o for o in known.values() if o != t and any(o[i : i + N] in mine for i in range(len(o) - N + 1))}
        assert got[k].shares_with == len(partners), k


def test_bitmap_by_ranges(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(spans, "PIECE_BITS", 1 << 12)
    h = np.random.default_rng(1).integers(-(2**62), 2**62, 20_000) * 2
    bitmap = spans.write_bitmap(spark.createDataFrame([(int(x),) for x in h], "h long"), 750_000, 300)
    assert bitmap.pieces > 8
    asked = np.concatenate([h, np.random.default_rng(2).integers(-(2**62), 2**62, 20_000) * 2 + 1]).view(np.uint64)
    whole = bitmap.test(asked)
    monkeypatch.setattr(spans, "HELD", 0)
    assert bitmap.test(asked).tolist() == whole.tolist()
    assert set(range(len(h))) <= set(whole.tolist()) and len(whole) < len(h) + 1000


def test_runs_and_passages_in_many_texts(spark):
    import time

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    notice = word(1500)
    docs = [(i, word(rng.randint(0, 200)) + notice[rng.randint(0, 300) : 1500 - rng.randint(0, 300)] + word(rng.randint(0, 200))) for i in range(2000)]
    docs += [(5000, "=" * 200_000), (5001, "x" + "=" * 200_000), (5002, "ab" * 100_000), (5003, "y" + "ab" * 90_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    began = time.perf_counter()
    shared = spans.shared_spans(df)
    shared = shared._replace(spans=shared.spans.cache(), passages=shared.passages.cache())
    assert spans.document_pairs(shared).count() == 2000 * 1999 // 2 + 2
    assert shared.passages.count() < 100_000  # sets of texts, not pairs
    got = {r.doc_id: r for r in spans.shared_fraction(df, shared).collect()}
    assert got[5000].shared_fraction == 1 and got[5001].shared_chars == 200_000 and got[5002].shared_chars == 200_000 and got[5003].shares_with == 1
    assert {got[i].shares_with for i in range(2000)} == {1999}
    assert time.perf_counter() - began < 120


def test_shared_fraction(spark):
    common = "".join(chr(97 + i % 26) + str(i) for i in range(40))
    docs = [(1, "left " + common + " one"), (2, "two: " + common), (3, "nothing in common here at all, and long enough too"), (4, "copy of a text that is long enough to count, yes"), (5, "copy of a text that is long enough to count, yes"), (6, None), (7, "short")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in spans.shared_fraction(df, spans.shared_spans(df, min_chars=N)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 7}
    assert got[1].shared_chars == len(common) + 1 and got[1].shares_with == 1  # with the blank before it
    assert got[3].shared_fraction == 0 and got[7].shared_fraction == 0
    assert got[4].shared_fraction == got[5].shared_fraction == 1 and got[4].class_id == got[5].class_id == 4


def test_hashes_depend_on_content_only():
    a = spans.window_hashes(spans.code_points("xxabcdefyy"), 6)
    b = spans.window_hashes(spans.code_points("abcdef"), 6)
    assert a[2] == b[0] and len(np.unique(a)) == len(a)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    shared = spans.shared_spans(df)
    assert spans.document_pairs(shared).count() == 0 and spans.shared_fraction(df, shared).count() == 0
