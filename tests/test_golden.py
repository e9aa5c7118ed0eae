"""Fixed values of the operators: ledgers, drawdown, sessions, labels, quantize, crossover, and the derived series."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import frames as W
from tidemark.functions import scalar as S
from tidemark.operators import align, recursive, scan, search, series, trading
from tidemark.operators.halo import halo, two_level_pos

#: Date, open, low, high, close, side, stop.
BARS = [
    ("2010-12-10", 21.63, 21.50, 23.01, 22.90, "long", 21.40),
    ("2010-12-11", 23.50, 22.00, 24.01, 24.00, "long", 23.00),
    ("2010-12-12", 25.00, 24.00, 25.01, 24.01, "long", 23.90),
    ("2010-12-13", 23.90, 23.10, 23.95, 23.15, "short", 24.00),
    ("2010-12-14", 23.10, 22.50, 23.50, 22.60, "short", 23.25),
    ("2010-12-15", 22.39, 22.20, 24.00, 23.50, "short", 24.10),
]


@pytest.fixture(scope="module")
def bars(spark):
    rows = [("ABCD", dt.datetime.fromisoformat(d), *r) for d, *r in BARS]
    return W.with_pos(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, low double, high double, close double, side string, stop double").withColumn("volume", F.lit(1)))


def line(spark, xs, symbol="s"):
    rows = [(symbol, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(x)) for i, x in enumerate(xs)]
    return W.with_pos(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double"))


def values(df, c="v"):
    return [r[c] for r in df.orderBy("symbol", "ts").collect()]


XS = [1, 4, 6, 2, 4, 7, 2, 4]


@pytest.mark.parametrize(
    ("operator", "want"),
    [
        (lambda d: series.sma(d, "x", 3, "v"), [1, 2.5, 3.666667, 4, 4, 4.333333, 4.333333, 4.333333]),
        (lambda d: series.sma(d, "x", 3, "v", "compat"), [1, 2, 3, 3.333333, 3.333333, 3.666667, 3.666667, 3.666667]),
        (lambda d: recursive.ema(d, "x", 3, "v"), [1, 2.5, 4.25, 3.125, 3.5625, 5.28125, 3.640625, 3.820312]),
        (lambda d: recursive.zlema(d, "x", 3, "v"), [1, 4, 6, 2, 4, 7, 2, 4]),
        (lambda d: series.momentum(d, "x", 3, "v"), [0, 3, 5, 1, 0, 1, 0, 0]),
        (lambda d: series.triangular_ma(d, "x", 3, "v"), [1, 2.25, 3, 2.444444, 2.444444, 3.444444, 2.666667, 2.555556]),
        (lambda d: series.parabolic_ma(d, "x", 3, "v"), [0.333333, 1.416667, 2.62963, 1.703704, 1.851852, 3, 1.851852, 1.888889]),
        (lambda d: series.lin_reg(d, "x", 3, 1, "v"), [1, 7, 8.666667, 2, 2, 9.333333, 2.333333, 1.333333]),
        (lambda d: series.extrapolate(d, "x", "v"), [1, 1, 7, 8, -2, 6, 10, -3]),
    ],
)
def test_derived_series(spark, operator, want):
    assert values(operator(line(spark, XS))) == pytest.approx(want, abs=2e-6)


def test_running_mean(spark):
    assert values(series.sma(line(spark, [1, 3, 8, 4]), "x", 3, "v")) == [1, 2, 4, 5]


def test_bar_indicators(bars):
    assert values(recursive.atr(bars, 3, "v")) == pytest.approx([1.51, 1.76, 1.51, 1.31, 1.206667, 1.404444], abs=1e-6)
    assert values(recursive.rsi(bars, "close", 3, "v")) == pytest.approx([50, 100, 100, 24.561404, 12.5, 66.438356], abs=1e-6)
    assert values(series.donchian_min(bars, 3, "v")) == pytest.approx([21.5, 21.5, 21.5, 22, 22.5, 22.2])
    assert values(series.donchian_max(bars, 3, "v")) == pytest.approx([23.01, 24.01, 25.01, 25.01, 25.01, 24])
    assert values(bars.withColumn("v", S.opening_wick())) == pytest.approx([0.13, 1.5, 0.01, 0.05, 0.4, 0.19])
    ha = recursive.heiken_ashi(bars)
    assert values(ha, "ha_close") == pytest.approx([22.9, 23.3775, 24.505, 23.525, 22.925, 23.0225])
    assert values(ha, "ha_open") == pytest.approx([21.63, 22.265, 22.82125, 23.663125, 23.594062, 23.259531], abs=1e-6)


def test_drawdown(spark):
    df = line(spark, [1, 2, 3, 4, 7, 5, 4, 5, 2, 10, 12, 11, 15])
    assert trading.max_drawdown(df, "x").collect()[0]["max_drawdown"] == pytest.approx(5 / 7)
    open_ = line(spark, [4, 8, 2])
    assert [trading.max_drawdown(open_, "x", o).collect()[0]["max_drawdown"] for o in (False, True)] == [0, 0.75]


def test_session_values(bars):
    rows = trading.session_exit(bars).orderBy("ts").collect()
    value, seen = 10000.0, []
    for r in rows:
        size = int((value - 5) // r["open"])
        value += size * (r["exit"] - r["entry"]) * (1 if r["side"] == "long" else -1) - 10
        seen.append(round(value, 2))
    assert seen == [10576.74, 10342.24, 9923.37, 10223.87, 10147.57, 9635.85]


def test_label(spark):
    df = line(spark, [10, 11, 12, 11, 10, 12, 12]).withColumnRenamed("x", "close")
    assert values(series.close_direction(df, "v")) == [0, 1, 1, -1, -1, 1, 1]


@pytest.mark.parametrize(("v", "least", "step", "want"), [(7, 2, 1, 7), (7, 0, 2, 8), (1.4, 1.3, 0.3, 1.3), (1.5, 1.3, 0.3, 1.6), (2.49, 0, 1, 2), (2.51, 0, 1, 3), (2.51, 0.5, 1, 2.5), (3.141592, 0, 0.001, 3.142), (3.141492, 0, 0.001, 3.141)])
def test_quantize(spark, v, least, step, want):
    assert spark.range(1).select(S.quantize(F.lit(float(v)), least, step)).first()[0] == pytest.approx(want)


def test_crossover(spark):
    gene = lambda xs: spark.createDataFrame([(0, i, str(i), float(x)) for i, x in enumerate(xs)], "pair int, ord int, name string, value double")
    out = search.crossover(gene([1, 2, 3, 4, 5]), gene([10, 20, 30, 40, 50]), F.col("ord") % 2 == 1).orderBy("ord").collect()
    assert ([r["x"] for r in out], [r["y"] for r in out]) == ([1, 20, 3, 40, 5], [10, 2, 30, 4, 50])


def test_weighted_picks(spark):
    items = spark.createDataFrame([(0, 1.5), (1, 8.0), (2, 0.5)], "id long, quality double")
    picks = spark.range(10000).select(F.col("id").alias("pick"), search.draw(3, "id").alias("u"))
    n = {r["id"]: r["count"] for r in search.weighted_pick(items, picks).groupBy("id").count().collect()}
    assert 1400 <= n[0] <= 1600 and 7900 <= n[1] <= 8100 and 400 <= n[2] <= 600
    two = search.weighted_pick_two(items, spark.range(500).withColumnRenamed("id", "pair"), 4).collect()
    assert len(two) == 500 and all(r["first"] != r["second"] for r in two)


LEDGER = "account string, symbol string, seq long, action string, shares long, price double"


@pytest.mark.parametrize(
    ("initial", "orders", "equity", "error"),
    [
        (10000, [("buy", 10, 1.5)], 9997, None),
        (10000, [("buy", 10, 1.5), ("sell", 10, 2.5)], 10004, None),
        (10000, [("short", 30, 5), ("cover", 30, 4)], 10024, None),
        (10000, [("buy", 10, 1), ("buy", 10, 2), ("sell", 20, 2.5)], 10011, None),
        (10000, [("short", 10, 2), ("short", 10, 3), ("cover", 20, 1.5)], 10011, None),
        (10000, [("buy", 20, 1), ("sell", 10, 2), ("sell", 10, 3)], 10021, None),
        (10000, [("short", 20, 5), ("cover", 10, 2), ("cover", 10, 3)], 10041, None),
        (10, [("buy", 4, 7.0)], 7, None),
        (10, [("buy", 4, 7.01)], 10, "Insufficient buying power"),
        (10, [("short", 4, 7.01)], 10, "Insufficient buying power"),
        (10000, [("buy", 4, 1), ("sell", 5, 1)], 9997, "More than the position"),
        (10000, [("short", 4, 1), ("cover", 5, 1)], 9997, "More than the position"),
        (10000, [("buy", 4, 1), ("short", 5, 1)], 9997, "Opposite position is open"),
    ],
)
def test_ledger(spark, initial, orders, equity, error):
    df = spark.createDataFrame([("a", "x", i, a, n, float(p)) for i, (a, n, p) in enumerate(orders)], LEDGER)
    last = trading.position_ledger(df, float(initial), 4.0, 3.0).orderBy(F.col("seq").desc()).first()
    assert last["equity"] == pytest.approx(equity) and last["error"] == error
    if last["position"] == 0:
        assert last["invested"] == 0 and last["buying_power"] == pytest.approx(4 * equity)


def test_max_shares(spark):
    assert spark.range(1).select(trading.max_shares(F.lit(28.0), 4.0, 3.0, F.lit(9.0))).first()[0] == 11


@pytest.mark.parametrize("p", [2, 3, 10, 100])
def test_blocks_equal_the_loop(spark, p):
    rng = random.Random(p)
    xs = [rng.gauss(0, 10) for _ in range(900)]
    df = line(spark, xs).unionByName(line(spark, xs[:5], "t")).unionByName(line(spark, [3], "u")).repartition(5)
    got = values(recursive.ema(df, "x", p, "v", block=64))
    k, want = 2 / (1 + p), []
    for part in (xs, xs[:5], [3]):
        v = part[0]
        for i, x in enumerate(part):
            v = x if i == 0 else k * x + (1 - k) * v
            want.append(v)
    assert got == pytest.approx(want, abs=1e-9)
    zl = values(recursive.zlema(line(spark, xs), "x", p, "v", block=64))
    lag, v = -(-(p - 1) // 2), 0.0
    for i, x in enumerate(xs):
        v = x if i < lag else k * (2 * x - xs[i - lag]) + (1 - k) * v
        assert zl[i] == pytest.approx(v, abs=1e-9)


def test_scan_near_one(spark):
    xs = [1.0] * 700
    df = scan.affine(line(spark, xs), 1.0, {"v": F.col("x")}, F.col("pos") == 0, block=64)
    assert values(df) == pytest.approx([float(i + 1) for i in range(700)])


def test_halo_and_pos(spark):
    rng = random.Random(9)
    df = line(spark, [rng.random() for _ in range(500)])
    plain = values(series.sma(df, "x", 10, "v"))
    assert values(halo(df, 9, 32, lambda d: series.sma(d, "x", 10, "v"))) == pytest.approx(plain)
    assert values(two_level_pos(df.drop("pos"), F.trunc("ts", "month")), "pos") == list(range(500))


def loop_swing(xs, s):
    """Row by row: a pivot s rows back, confirmed by s rows on either side, holds until a higher row."""
    out, level, known = [], None, False
    for t, x in enumerate(xs):
        if t < 2 * s:
            out.append(0.0)
            continue
        m = xs[t - s]
        if all(xs[t - s - i] < m for i in range(1, s + 1)) and all(xs[t - i] <= m for i in range(s)):
            level, known = m, True
        if level is not None and x > level:
            level = None
        out.append(level if known else None)
    return out


def test_swing_equals_the_loop(spark):
    for seed in range(6):
        rng = random.Random(seed)
        xs = [float(rng.randint(0, 9)) for _ in range(80)]
        for s in (1, 2, 3):
            assert values(series.swing(line(spark, xs), s, "x", "v")) == loop_swing(xs, s)


def test_calendar_does_not_carry(spark):
    day = lambda d: dt.datetime(2020, 1, d)
    rows = [("a", day(1), 1.0), ("a", day(3), 2.0), ("a", day(4), 3.0), ("b", day(2), 7.0), ("b", day(3), 8.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double").withColumns({c: F.col("close") for c in ("open", "high", "low")}).withColumn("volume", F.lit(1))
    out = align.align_calendar(df, "a", ["b"]).orderBy("ts").collect()
    assert [(r["close"], r["filled"]) for r in out] == [(8.0, True), (8.0, False), (8.0, True)]


def test_zip_needs_equal_lengths(spark):
    a, b = line(spark, [1, 2, 3]), line(spark, [1, 2])
    with pytest.raises(Exception, match="equal length"):
        align.zip_series(a, b, "x", "x").collect()


def test_edges(spark, bars):
    none = bars.limit(0)
    assert values(recursive.ema(W.with_pos(none.drop("pos")), "close", 3, "v")) == []
    flat = line(spark, [5, 5, 5])
    assert values(series.normalize_unit(flat, "x", "v")) == [None] * 3 and values(series.r_squared(flat, "x", 2, "v")) == [0, 0, 0]
    assert values(series.percent_return(line(spark, [0, 1]), "x", "v")) == [0, None]
    assert values(series.sma(line(spark, [1, 3]), "x", 10, "v")) == [1, 2]


@pytest.mark.parametrize("n", [1, 4, 17])
def test_partitioning_does_not_matter(spark, bars, n):
    assert values(recursive.macd(bars.repartition(n), "close", 2, 4, "v")) == pytest.approx(values(recursive.macd(bars, "close", 2, 4, "v")))
