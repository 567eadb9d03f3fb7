import numpy as np
import pytest

from lodeseam.llm import neighbours as nb

PLAN = nb.Plan(dims=16)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 16))
    near = base[:60] + rng.standard_normal((60, 16)) * 0.08
    x = np.concatenate([base, near, base[:5] * 3.0, base[:3]])
    models = ["a" if i % 3 else "b" for i in range(300)]
    models += models[:60] + models[:5] + models[:3]
    return x, models


def frame(spark, x, models):
    rows = [(i, m, [float(v) for v in row]) for i, (row, m) in enumerate(zip(x, models))]
    bad = [(900, "a", None), (901, "a", []), (902, "a", [0.0] * 16), (903, "a", [1.0] * 8), (904, None, [1.0] * 16), (905, "a", [float("nan")] * 16), (906, "a", [None] * 16), (None, "a", [1.0] * 16), rows[0]]
    return spark.createDataFrame(rows + bad, "id long, model string, vector array<double>").selectExpr("*", "1 as rep", "2 as cell")


def cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T


def test_pairs_equal_brute_force(spark, data):
    x, models = data
    s = cosines(x)
    true = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if models[i] == models[j] and s[i, j] >= 0.9}
    got = [(r.a, r.b) for r in nb.expand(*nb.similar_pairs(frame(spark, x, models), 0.9, PLAN)).collect()]
    assert len(got) == len(set(got)) and set(got) <= true
    assert len(set(got)) >= 0.99 * len(true)


@pytest.mark.parametrize("bits", [9, 15])
def test_pairs_at_the_threshold_whatever_the_size(spark, bits):
    """Cells of `bits` signs, as a collection of 24 * 2 ** bits vectors has."""
    rng = np.random.default_rng(5)
    n, cosine = 1500, 0.9005
    a = rng.standard_normal((n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((n, 64))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * side])
    df = spark.createDataFrame([(i, "m", row.tolist()) for i, row in enumerate(x)], "id long, model string, vector array<double>")
    got = {(r.a, r.b) for r in nb.similar_pairs(df, 0.9, nb.Plan(cell=2 * n / 2**bits))[0].collect()}
    assert got <= {(i, i + n) for i in range(n)}
    assert len(got) >= 0.995 * n


def test_tables_follow_the_signs():
    agree = 1 - np.arccos(0.9) / np.pi
    for bits in (1, 9, 12, 15, 20):
        assert (1 - agree**bits) ** nb.tables_needed(bits, 0.9, nb.Plan()) <= 1e-3
    assert nb.tables_needed(9, 1.0, nb.Plan()) == 24


def test_top_k_recall(spark, data):
    x, models = data
    df = frame(spark, x, models)
    s = cosines(x)
    np.fill_diagonal(s, -2)
    got = nb.top_k(df, df.filter("id % 50 = 0").select("id"), 5, nb.Plan(dims=16, collisions=24)).collect()
    hit = total = 0
    for q in range(0, len(x), 50):
        same = [j for j in range(len(x)) if models[j] == models[q] and j != q]
        best = set(sorted(same, key=lambda j: (-s[q, j], j))[:5])
        hit += len(best & {r.neighbour for r in got if r.id == q})
        total += 5
    assert hit / total >= 0.9


def test_windows_across_batches():
    cell = np.zeros(6, np.int64)
    p0 = np.arange(6, dtype=np.int32)
    values = np.zeros((6, 4), np.int8)
    whole = {(int(a), int(b)) for x, y in nb.count_pairs(cell, p0, values, 0, 2, 4) for a, b in zip(x, y)}
    assert whole == {(i, j) for i in range(6) for j in range(i + 1, 6) if j - i <= 2}
    late = {(int(a), int(b)) for x, y in nb.count_pairs(cell, p0, values, 3, 2, 4) for a, b in zip(x, y)}
    assert late == {p for p in whole if p[1] >= 3}


def test_empty(spark):
    df = spark.createDataFrame([], "id long, model string, vector array<double>")
    assert nb.expand(*nb.similar_pairs(df)).count() == 0
    assert nb.top_k(df, df.select("id")).count() == 0
