"""Operators on series cut into short buckets, beside plain loops."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from tidemark.functions import frames as W
from tidemark.operators import recursive as R
from tidemark.operators import scan, series
from tidemark.operators.halo import halo


def line(spark, xs):
    rows = [("s", dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), float(x), float(x) + abs(math.sin(i)), float(x) - abs(math.cos(i)), float(x) + math.sin(i) / 2) for i, x in enumerate(xs)]
    return W.with_pos(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double").repartition(4))


def values(df, c="v"):
    return [r[c] for r in df.orderBy("ts").collect()]


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(12)
    return line(spark, [50 + rng.gauss(0, 5) for _ in range(3000)]).cache()


def ema(xs, k, start=None):
    out = []
    for x in xs:
        out.append(x if not out else k * x + (1 - k) * out[-1])
    return out


def test_averages_forget_across_buckets(long):
    xs = values(long, "close")
    for p in (2, 5, 9):
        assert scan.longest(1 - 2 / (1 + p)) < 3000  # so that there are several buckets
        assert values(R.ema(long, "close", p, "v")) == pytest.approx(ema(xs, 2 / (1 + p)), abs=1e-9)
    fast, slow = ema(xs, 2 / 4), ema(xs, 2 / 8)
    assert values(R.macd(long, "close", 3, 7, "v")) == pytest.approx([a - b for a, b in zip(fast, slow, strict=True)], abs=1e-9)


def test_recurrences_with_windows_around_them(long):
    o, h, lo, c = (values(long, x) for x in ("open", "high", "low", "close"))
    tr = [max(h[i] - lo[i], *([abs(lo[i] - c[i - 1]), abs(h[i] - c[i - 1])] if i else [0])) for i in range(len(c))]
    want = []
    for i, t in enumerate(tr):
        n = min(i + 1, 4)
        want.append(((n - 1) * want[-1] + t) / n if i else t)
    assert values(R.atr(long, 4, "v")) == pytest.approx(want, abs=1e-9)
    e = ema([a - b for a, b in zip(h, lo, strict=True)], 2 / 4)
    want = [100 * (e[i] - e[max(0, i - 3)]) / e[max(0, i - 3)] for i in range(len(e))]
    assert values(R.chaikin_volatility(long, 3, "v")) == pytest.approx(want, abs=1e-7)
    ho, hc = o[0], c[0]
    got = values(R.heiken_ashi(long), "ha_open")
    for i in range(len(c)):
        if i:
            ho, hc = (ho + hc) / 2, (o[i] + h[i] + lo[i] + c[i]) / 4
        assert got[i] == pytest.approx(ho, abs=1e-9)


def test_factors_that_no_bucket_suits(long):
    """A factor that forgets within a few rows beside one that takes thousands: each gets its own buckets."""
    xs = values(long, "close")
    want = [a - b for a, b in zip(ema(xs, 2 / 3), ema(xs, 2 / 1001), strict=True)]
    assert values(R.macd(long, "close", 2, 1000, "v")) == pytest.approx(want, abs=1e-7)


def test_sums_and_swings_from_blocks(long, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 128)
    xs = values(long, "close")
    total, want = 1.0, []
    for x in xs:
        total += x
        want.append(total)
    assert values(series.integral(long, "close", 1.0, "v")) == pytest.approx(want, rel=1e-12)
    for side in ("high", "low"):
        for revise in (False, True):
            whole = values(series.swing(long, 2, "close", "v", side, revise))
            assert values(series.swing(long, 2, "close", "v", side, revise, block=7)) == whole


def test_rows_ahead_and_short_buckets(long):
    plain = values(series.next_close_label(long, "v"))
    assert values(halo(long, 0, 16, lambda d: series.next_close_label(d, "v"), 1)) == plain
    with pytest.raises(ValueError):
        halo(long, 20, 10, lambda d: d)


def test_compat_average_in_buckets(long):
    xs, v = values(long, "close"), None
    got = values(halo(series.with_heads(long, ["close"], 6), 6, 32, lambda d: series.sma(d, "close", 6, "v", "compat")))
    for i, x in enumerate(xs):
        v = x if i == 0 else (v * (i + 1) + x) / (i + 2) if i < 6 else v + (x - xs[i - 6]) / 6
        assert got[i] == pytest.approx(v, abs=1e-9)
