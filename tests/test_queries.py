"""Every registered query against its SQL on the smallest test tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = entry.SMOKE
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n in entry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 2e-4 * max(1, abs(x))) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql()))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0 or name == "p3_clusters"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
