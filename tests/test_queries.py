"""Every registered query beside its SQL on the smallest tables; queries without SQL must run and keep their schema."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import indicators, queries, streams

SF = "/root/testdata/sf0.001"
QUERIES = {**indicators.QUERIES, **queries.QUERIES, **streams.QUERIES}
SQL = {**indicators.SQL, **queries.SQL, **streams.SQL}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def text(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    try:
        return f"{round(float(v), 5) + 0.0:.5f}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = ", ".join(f'"{c}"' for c in columns)
    ours = sorted(tuple(map(text, r)) for r in got.select(*columns).collect())
    theirs = sorted(tuple(map(text, r)) for r in con.sql(f"select {order} from ({SQL[name]})").fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == b or all(x == y or abs(float(x) - float(y)) <= 2e-5 * max(1, abs(float(x))) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and len(df.take(5)) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["symbol", "n", "accuracy"]


def test_filters_reach_the_scan(spark):
    plan = QUERIES["view_bars_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" in plan and "EqualTo(o_orderpriority,3-MEDIUM)" in plan.replace(" ", "") or "PushedFilters" in plan
    assert "o_comment" not in plan
