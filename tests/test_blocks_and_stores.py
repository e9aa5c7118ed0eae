"""Drawdowns joined from blocks, history functions in blocks, windows of a size a row, and stores that are written twice."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import frames as W
from tidemark.operators import history as H
from tidemark.operators import search as G
from tidemark.operators import trading as T
from tidemark.sources import sinks

BAR = "symbol string, ts timestamp_ntz, close double"


def bars(spark, series, hours=30):
    rows = [(s, dt.datetime(2019, 11, 20) + dt.timedelta(hours=hours * i), float(x)) for s, xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, BAR).repartition(3)


def drawdown(xs, include_open):
    peak, low, worst = None, None, 0.0
    for x in xs:
        if peak is None or x >= peak:
            worst = max(worst, (peak - low) / peak) if peak is not None else worst
            peak = low = x
        low = min(low, x)
    return max(worst, (peak - low) / peak) if include_open else worst


@pytest.mark.parametrize("include_open", [False, True])
def test_drawdowns_equal_the_loop(spark, include_open):
    rng = random.Random(8)
    series = {f"s{k}": [rng.choice([rng.randint(1, 9), rng.randint(50, 60)]) + i * rng.choice([0, 0.2]) for i in range(n)] for k, n in enumerate([1, 2, 30, 300, 700, 700])}
    series |= {"down": list(range(400, 0, -1)), "up": list(range(1, 400)), "flat": [5] * 200}
    for unit in ("month", "day"):
        got = {r["symbol"]: r["max_drawdown"] for r in T.max_drawdown(bars(spark, series), "close", include_open, unit).collect()}
        assert got == {s: pytest.approx(drawdown(xs, include_open)) for s, xs in series.items()}


def test_a_rising_series_of_a_million_rows(spark):
    ts = (F.lit(dt.datetime(2010, 1, 1)) + F.make_interval(mins=F.col("id").cast("int"))).cast("timestamp_ntz")
    rising = spark.range(1_000_000).select(F.lit("s").alias("symbol"), ts.alias("ts"), (F.col("id") + 1.0).alias("close"))
    assert [tuple(r) for r in T.max_drawdown(rising, "close", True).collect()] == [("s", 0.0)]


def test_history_in_blocks_equals_the_fold(spark):
    rng = random.Random(2)
    series = {s: [rng.randint(0, 20) for _ in range(n)] for s, n in (("a", 1), ("b", 50), ("c", 333))}
    df = W.with_pos(bars(spark, series))
    merge = lambda a, b: [a[0] + b[0], a[1] + [x for x in b[1] if x not in a[1]]]
    step = lambda s, x: merge(s, [1, [x]])
    for rows in (1, 7, 1000):
        out = H.map_blocks(df, ["close"], lambda: [0, []], step, merge, lambda s, x: s[0] + 1000.0 * len(s[1]), "v", rows)
        got = {(r["symbol"], r["ts"]): r["v"] for r in out.collect()}
        for s, xs in series.items():
            own = [v for (name, _), v in sorted(got.items()) if name == s]
            assert own == [i + 1 + 1000.0 * len(set(xs[: i + 1])) for i in range(len(xs))]
    keys = H.map_blocks(df, ["close"], lambda: [0, []], step, merge, lambda s, x: 0.0, "v", 7)._jdf.queryExecution().executedPlan().toString()
    assert keys.count("hashpartitioning(symbol") >= 2 and "hashpartitioning(symbol" in keys and ", block" in keys


def test_windows_of_each_rows_size(spark):
    df = W.with_pos(bars(spark, {"a": range(20), "b": range(5)}))
    out = H.sized_examples(df, "close", (F.col("pos") % 4 + 1), 4).collect()
    assert len(out) == 25
    for r in out:
        n = int(r["pos"] % 4) + 1
        assert r["example"] == [float(x) for x in range(max(0, r["pos"] - n + 1), r["pos"] + 1)]


@pytest.mark.parametrize(("drop", "most"), [("x", 3), (None, 0), (None, "three")])
def test_a_table_function_says_what_it_lacks(spark, drop, most):
    df = bars(spark, {"a": [1, 2]}).withColumn("x", F.col("close")).withColumn("size", F.lit(1))
    with pytest.raises(Exception, match="lacks|whole number"):
        H.Examples((df.drop(drop) if drop else df).asTable(), F.lit(most)).collect()


def test_an_append_run_twice_or_broken_off_leaves_one_copy(spark, tmp_path):
    path, rows = str(tmp_path / "store"), spark.range(10).select("id", (F.col("id") % 2).alias("run_id"))
    assert sinks.store_read(spark, path, rows.schema).count() == 0
    assert sinks.store_append(rows, path, "a") and not sinks.store_append(rows, path, "a")

    def failing(batches):
        for batch in batches:
            yield batch
        raise RuntimeError("the writer is lost")

    broken = rows.repartition(2).mapInPandas(failing, rows.schema)
    with pytest.raises(Exception, match="the writer is lost"):
        sinks.store_append(broken, path, "b")
    read = lambda: sorted(tuple(r) for r in sinks.store_read(spark, path, rows.schema).collect())
    one = sorted(tuple(r) for r in rows.collect())
    assert read() == one
    assert sinks.store_append(rows, path, "b") and read() == sorted(one + one)
    with pytest.raises(ValueError):
        sinks.store_append(rows, path, "../b")


def test_a_grid_meets_prepared_bars(spark):
    df = W.with_pos(bars(spark, {"a": range(9)}))
    kernel = lambda d: d.where("old is not null").groupBy("n").agg(F.sum(F.col("close") * F.col("n") - F.col("old")).alias("v"))
    for most in (0, 100):
        out = G.grid_search(df, G.param_grid(spark, {"n": (1.0, 3.0, 1.0)}), kernel, lambda d: d.withColumn("old", W.lagged("close", 2)), 2, 0, most)
        assert {r["n"]: r["v"] for r in out.collect()} == {n: sum(n * i - (i - 2) for i in range(2, 9)) for n in (1.0, 2.0, 3.0)}


def test_buckets_of_dense_series(spark):
    ticks = spark.range(4000).select(F.lit("s").alias("symbol"), (F.lit(dt.datetime(2020, 1, 31, 22)) + F.make_interval(secs=F.col("id").cast("decimal(18,6)"))).cast("timestamp_ntz").alias("ts"), "id")
    for most, n in ((5000, 1), (3600, 2), (60, 67), (1, 4000)):
        bucket = W.bucket_of(ticks, most)
        assert ticks.select(bucket).distinct().count() == n
        assert W.with_pos(ticks, bucket).where("pos <> id").count() == 0
    assert W.with_pos(ticks.limit(0), W.bucket_of(ticks.limit(0))).count() == 0
