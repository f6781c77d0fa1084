"""Every named query against its SQL in DuckDB on the smallest tables, if these are there."""

import glob
import os

import pytest

from tidemark.plans.oracles import SQL
from tidemark.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    mine = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)
    theirs = duck.sql(SQL[name])
    assert sorted(theirs.columns) == cols
    want = sorted((tuple(r) for r in theirs.project(",".join(f'"{c}"' for c in cols)).fetchall()), key=repr)
    assert len(mine) == len(want)
    for a, b in zip(mine, want):
        assert all(type(x) is type(y) for x, y in zip(a, b))
        assert a == pytest.approx(b, abs=1e-9) if all(isinstance(x, (int, float)) for x in a) else a == b


@pytest.mark.parametrize("name", ["select_greedy_onehop", "select_opimc", "select_imm", "select_hybrid"])
def test_selection_runs(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    assert len({r["p"] for r in rows}) == len(rows) > 0 and all(r["gain"] >= 0 for r in rows)
