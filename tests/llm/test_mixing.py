import pytest

from lodeseam.llm import mixing


@pytest.mark.parametrize("rate,cap", [(0.3, 1), (0.65, 4), (1.8, 3), (2.999, 3), (10.0, 20), (0.0, 2), (1990.0, 2000), (1500.5, 2000)])
def test_cut_mean_is_the_rate(rate, cap):
    cdf = mixing.cut_poisson(rate, cap)
    assert len(cdf) == cap and sum(1 - c for c in cdf) == pytest.approx(rate, abs=1e-6)


@pytest.fixture(scope="module")
def tables(spark):
    sizes = [(i, "big", 10) for i in range(4000)] + [(i, "small", 10) for i in range(4000, 4400)] + [(i, "tiny", 10) for i in range(4400, 4410)] + [(9001, None, 50), (9002, "other", 70), (9003, "big", None), (9004, "big", 0)]
    targets = [("big", 0.5, 1), ("small", 0.3, 5), ("tiny", 0.2, 3), ("none", 0.0, 2), ("small", 0.3, 5), (None, 0.1, 1)]
    return spark.createDataFrame(sizes, "doc_id long, source string, size long").selectExpr("*", "1 as rate", "2 as total"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_rates(tables):
    rates = {r.source: r for r in mixing.source_rates(*tables).collect()}
    assert set(rates) == {"big", "small", "tiny", "none"}
    assert rates["big"].total == 44100 and rates["big"].size == 40000
    assert {s for s, r in rates.items() if r.falls_short} == {"tiny"}


def test_mix(tables):
    sizes, _ = tables
    rates = mixing.source_rates(*tables)
    mixed = mixing.mix(sizes, rates).collect()
    uses = {}
    for r in mixed:
        uses.setdefault((r.source, r.doc_id), []).append(r.copy_no)
    caps = {"big": 1, "small": 5, "tiny": 3}
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= caps[s] for (s, _), v in uses.items())
    total = {s: sum(r.size or 0 for r in mixed if r.source == s) for s in caps}
    assert total["tiny"] == 10 * 10 * 3  # the cap, used wholly
    assert total["big"] == pytest.approx(0.5 * 44100, rel=0.05) and total["small"] == pytest.approx(0.3 * 44100, rel=0.1)
    assert len({r.position for r in mixed}) == len(mixed)
    again = {(r.doc_id, r.copy_no, r.position) for r in mixing.mix(sizes, rates).collect()}
    assert again == {(r.doc_id, r.copy_no, r.position) for r in mixed}


def test_shares(tables):
    sizes, _ = tables
    rates = mixing.source_rates(*tables)
    got = {r.source: r for r in mixing.shares(mixing.mix(sizes, rates), rates).collect()}
    assert sum(r.reached_share for r in got.values()) == pytest.approx(1.0)
    assert {k for k, r in got.items() if r.falls_short} == {r.source for r in rates.filter("falls_short").collect()} == {"tiny"}
    assert got["none"].mixed_size == 0 and got["tiny"].share_of_planned < 0.2


def test_empty(spark, tables):
    sizes, targets = tables
    assert mixing.source_rates(sizes.limit(0), targets).filter("falls_short").count() == 0
    rates = mixing.source_rates(sizes, targets.limit(0))
    assert mixing.mix(sizes, rates).count() == 0 and mixing.shares(mixing.mix(sizes, rates), rates).count() == 0
