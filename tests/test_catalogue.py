"""Every query of the catalogue on the smallest tables, against its SQL where it has one."""

import math
import os

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return str(v)[:10] if hasattr(v, "isoformat") else v


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, db, name):
    if name not in QUERIES:
        pytest.skip("not registered")
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(db.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and not n.startswith("p")))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
