"""Path-dependent indicators as affine scans; every one takes rows with pos and adds one column (heiken_ashi: four).

Each runs in buckets of its series, with all windows it needs (scan.spread); block asks for composed blocks instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import frames as W
from tidemark.functions import scalar as S
from tidemark.operators import series
from tidemark.operators.scan import affine, spread


def fade(p: float) -> float:
    """What an exponential average over p keeps of its last value."""
    return 1 - 2 / (1 + p)


def emas(df: DataFrame, columns: dict[str, Column], p: int, block: int | None = None) -> DataFrame:
    """Exponential averages of several columns in one scan: k x + (1 - k) v with k = 2 / (1 + p), from the first x."""
    steps = {out: F.when(F.col("pos") == 0, x).otherwise(x * (2 / (1 + p))) for out, x in columns.items()}
    return affine(df, fade(p), steps, F.col("pos") == 0, block)


def ema(df: DataFrame, x: str | Column, p: int, out: str, block: int | None = None) -> DataFrame:
    return emas(df, {out: S.col(x)}, p, block)


def zlema(df: DataFrame, x: str, p: int, out: str, block: int | None = None) -> DataFrame:
    """Average of 2x less x half a period ago; x itself while there is no such row; p = 1 starts from 0."""
    lag, k = -(-(p - 1) // 2), 2 / (1 + p)
    if p == 1:
        return df.withColumn(out, F.when(F.col("pos") == 0, 0.0).otherwise(F.col(x)))

    def run(d: DataFrame) -> DataFrame:
        d = d.withColumn("_lead", (2 * F.col(x) - W.lagged(x, lag)) * k)
        step = F.when(F.col("pos") < lag, F.col(x)).otherwise(F.col("_lead"))
        return affine(d, 1 - k, {out: step}, F.col("pos") < lag, block).drop("_lead")

    return spread(df, lag, [1 - k], run, block)


def true_range(df: DataFrame, out: str) -> DataFrame:
    old = W.lagged("close", 1)
    span = F.col("high") - F.col("low")
    return df.withColumn(out, F.greatest(span, F.coalesce(F.abs(F.col("low") - old), span), F.coalesce(F.abs(F.col("high") - old), span)))


def atr(df: DataFrame, p: int, out: str, block: int | None = None) -> DataFrame:
    """Average true range: the mean of what there is, then ((p - 1) v + range) / p."""

    def run(d: DataFrame) -> DataFrame:
        d = true_range(d, "_range")
        d = d.withColumn("_mean", F.avg("_range").over(W.last(p)))  # read in a series' first p rows only
        step = F.when(F.col("pos") < p, F.col("_mean")).otherwise(F.col("_range") / p)
        return affine(d, (p - 1) / p, {out: step}, F.col("pos") < p, block).drop("_range", "_mean")

    return spread(df, p, [(p - 1) / p], run, block)


def heiken_ashi(df: DataFrame, block: int | None = None) -> DataFrame:
    """Adds ha_open, ha_low, ha_high, ha_close; only the open is recursive, as half itself and half the last ha_close."""
    mean = (F.col("open") + F.col("low") + F.col("high") + F.col("close")) / 4

    def run(d: DataFrame) -> DataFrame:
        d = d.withColumn("ha_close", F.when(F.col("pos") == 0, F.col("close")).otherwise(mean))
        d = d.withColumn("_old", W.lagged("ha_close", 1) / 2)
        return affine(d, 0.5, {"ha_open": F.when(F.col("pos") == 0, F.col("open")).otherwise(F.col("_old"))}, F.col("pos") == 0, block)

    df = spread(df, 1, [0.5], run, block)
    later = F.when(F.col("pos") > 0, F.col("ha_open"))
    return df.withColumn("ha_low", F.least("low", later)).withColumn("ha_high", F.greatest("high", later)).drop("_old")


def macd(df: DataFrame, x: str, fast: int, slow: int, out: str, block: int | None = None) -> DataFrame:
    run = lambda d: ema(ema(d, x, fast, "_fast", block), x, slow, "_slow", block)
    df = spread(df, 0, [fade(fast), fade(slow)], run, block)
    return df.withColumn(out, F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")


def rsi(df: DataFrame, x: str, p: int, out: str, block: int | None = None) -> DataFrame:
    """Share of upward moves in percent from two averages in one scan: 50 in the first row, 100 where nothing fell, null where nothing moved."""

    def run(d: DataFrame) -> DataFrame:
        d = d.withColumn("_move", F.coalesce(F.col(x) - W.lagged(x, 1), F.lit(0.0)))
        return emas(d, {"_up": F.greatest("_move", F.lit(0.0)), "_down": F.greatest(-F.col("_move"), F.lit(0.0))}, p, block)

    df = spread(df, 1, [fade(p)], run, block)
    ratio = 100 - 100 / (1 + F.try_divide(F.col("_up"), F.col("_down")))
    value = F.when(F.col("pos") == 0, 50.0).when((F.col("_down") == 0) & (F.col("_up") > 0), 100.0).otherwise(ratio)
    return df.withColumn(out, value).drop("_move", "_up", "_down")


def chaikin_volatility(df: DataFrame, p: int, out: str, block: int | None = None) -> DataFrame:
    """Change in percent of the averaged high - low against p rows ago, or the first row."""

    def run(d: DataFrame) -> DataFrame:
        d = ema(d, F.col("high") - F.col("low"), p, "_e", block)
        old = F.coalesce(W.lagged("_e", p), F.first("_e").over(W.so_far()))
        return d.withColumn(out, F.try_divide(100 * (F.col("_e") - old), old)).drop("_e")

    return spread(df, p, [fade(p)], run, block)


def reversal_index(df: DataFrame, p: int, out: str, block: int | None = None) -> DataFrame:
    """Average of 1 where a bar has its predecessor's colour and -1 where not, from 0."""

    def run(d: DataFrame) -> DataFrame:
        d = series.flips(d).withColumn("_same", F.coalesce(1 - 2 * F.col("_flip"), F.lit(0.0)))
        return ema(d, "_same", p, out, block).drop("_flip", "_same")

    return spread(df, 1, [fade(p)], run, block)


def anti_trend_index(df: DataFrame, slope: int, p: int, out: str, block: int | None = None) -> DataFrame:
    """Average of 1 where the sign of the closes' slope fits the bar's colour and -1 where not."""

    def run(d: DataFrame) -> DataFrame:
        d = series.lin_reg_slope(d, "close", slope, "_slope")
        d = d.withColumn("_fits", F.when((F.col("_slope") >= 0) == S.is_green(), 1.0).otherwise(-1.0))
        return ema(d, "_fits", p, out, block).drop("_slope", "_fits")

    return spread(df, slope, [fade(p)], run, block)


def wick_stops(df: DataFrame, p: int, cutoff: int, smooth: int, out: str, block: int | None = None) -> DataFrame:
    """Average over smooth + 1 of the cutoff-th largest (from 0) opening wick of p bars, 0 while there are fewer."""

    def run(d: DataFrame) -> DataFrame:
        d = d.withColumn("_wick", S.opening_wick())
        ranked = F.get(F.sort_array(F.collect_list("_wick").over(W.last(p)), asc=False), F.lit(min(cutoff, p - 1)))
        d = d.withColumn("_kth", F.when(F.col("pos") < p - 1, 0.0).otherwise(ranked))
        return ema(d, "_kth", smooth + 1, out, block).drop("_wick", "_kth")

    return spread(df, p, [fade(smooth + 1)], run, block)
