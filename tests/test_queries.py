"""Every query that has SQL gives what DuckDB gives for it."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for plan in entry.PLANS for n in plan.QUERIES]
SQL = {n: s for plan in entry.PLANS for n, s in plan.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return round(float(v), 5) if hasattr(v, "quantize") else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    assert got
    if name not in SQL:
        return
    res = duck.execute(SQL[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in res.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
