"""Finite-frame operators over series (symbol, ts, ...): each adds one column computed by plain windows.

All windows of an operator share one partitioning and order, so Spark sorts a series once. Rows whose history is short
hold 0 where the operator is said to warm up with 0. Operators that need a row's place expect `pos` (frames.with_pos).
On long series they run in buckets (halo.halo) of which the reach is the rows they look back on; normalize_unit, integral
and swing, which look back without end, and the first values that sma's compat mode needs (with_heads) are put together
from summaries of blocks themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import frames as W
from tidemark.functions import scalar as S
from tidemark.operators.halo import ROWS, halo
from tidemark.operators.scan import affine


def add(df: DataFrame, out: str, value: Column, *temporary: str) -> DataFrame:
    return df.withColumn(out, value).drop(*temporary)


def with_heads(df: DataFrame, columns: list[str] | tuple[str, ...], p: int) -> DataFrame:
    """Adds _first_x and _head_x for each column: a series' first value, and the sum of its first p."""
    early = df.where(F.col("pos") < p).groupBy("symbol")
    heads = early.agg(*[F.min_by(x, "pos").alias(f"_first_{x}") for x in columns], *[F.sum(x).alias(f"_head_{x}") for x in columns])
    return df.join(heads, "symbol")


def sma(df: DataFrame, x: str, p: int, out: str, mode: str = "textbook") -> DataFrame:
    """Moving average. compat: the first value weighs twice until the frame is full, and its surplus stays for ever."""
    if mode == "textbook":
        return add(df, out, F.avg(x).over(W.last(p)))
    if f"_head_{x}" not in df.columns:
        return sma(with_heads(df, [x], p), x, p, out, mode).drop(f"_first_{x}", f"_head_{x}")
    first, head = F.col(f"_first_{x}"), F.col(f"_head_{x}")
    early = (first + F.sum(x).over(W.last(p))) / (F.col("pos") + 2)
    late = F.avg(x).over(W.last(p)) + (first - head / p) / (p + 1)
    return add(df, out, F.when(F.col("pos") < p, early).otherwise(late))


def momentum(df: DataFrame, x: str, p: int, out: str) -> DataFrame:
    """x minus the value p rows ago, or the first one."""
    return add(df, out, F.col(x) - F.coalesce(W.lagged(x, p), F.first(x).over(W.so_far())))


def trend(df: DataFrame, n: int, out: str) -> DataFrame:
    """Sign of green minus red among the n bars before; 0 while there are fewer."""
    return add(df, out, F.when(F.col("pos") < n, 0.0).otherwise(F.signum(F.sum(W.green()).over(W.before(n)))))


def channel(low: str, high: str, p: int, bloat: float) -> tuple[Column, Column]:
    bottom, top = F.min(low).over(W.last(p)), F.max(high).over(W.last(p))
    middle, reach = (bottom + top) / 2, (top - bottom) / 2 * (1 + bloat)
    return middle - reach, middle + reach


def donchian_min(df: DataFrame, p: int, out: str, bloat: float = 0.0) -> DataFrame:
    return add(df, out, channel("low", "high", p, bloat)[0])


def donchian_max(df: DataFrame, p: int, out: str, bloat: float = 0.0) -> DataFrame:
    return add(df, out, channel("low", "high", p, bloat)[1])


def donchian_avg(df: DataFrame, p: int, out: str) -> DataFrame:
    low, high = channel("low", "high", p, 0.0)
    return add(df, out, (low + high) / 2)


def donchian_pct(df: DataFrame, p: int, x: str, out: str) -> DataFrame:
    """Where x lies in the channel; null where the channel is flat."""
    low, high = channel("low", "high", p, 0.0)
    return add(df, out, F.try_divide(F.col(x) - low, high - low))


def flips(df: DataFrame) -> DataFrame:
    """Adds _flip: 1 where a bar's colour differs from the one before, 0 where it doesn't, null at the start."""
    return df.withColumn("_flip", (W.green() != F.lag(W.green()).over(W.line())).cast("double"))


def reversal_volatility(df: DataFrame, p: int, out: str) -> DataFrame:
    """Sum of ((p - i) / p)^2 over colour flips i = 1..p-1 rows back; 0 until there are p rows."""
    parts = [F.coalesce(W.lagged("_flip", i - 1), F.lit(0.0)) * ((p - i) / p) ** 2 for i in range(1, p)]
    return add(flips(df), out, F.when(F.col("pos") < p - 1, 0.0).otherwise(sum(parts, F.lit(0.0))), "_flip")


def reversals2(df: DataFrame, p: int, k: float, out: str) -> DataFrame:
    """Weighted flips less k times weighted steadiness over p neighbouring pairs, not below 0; 0 until there are p + 1 rows."""
    weight = [(p - i) / p for i in range(p)]
    flip = [F.coalesce(W.lagged("_flip", i), F.lit(0.0)) for i in range(p)]
    total = sum((f * w - (1 - f) * (w * k) for f, w in zip(flip, weight, strict=True)), F.lit(0.0))
    return add(flips(df), out, F.when(F.col("pos") < p, 0.0).otherwise(F.greatest(F.lit(0.0), total)), "_flip")


def bar_sum1(df: DataFrame, p: int, out: str) -> DataFrame:
    """Sum of close - open over p bars, divided by p even where there are fewer."""
    return add(df, out, F.sum(F.col("close") - F.col("open")).over(W.last(p)) / p)


def linear_weighted(x: Column, p: int) -> tuple[Column, Column]:
    n = F.least(F.col("pos") + 1, F.lit(p)).cast("double")
    return F.sum(F.col("pos") * x).over(W.last(p)) + (n - F.col("pos")) * F.sum(x).over(W.last(p)), n


def bar_sum2(df: DataFrame, p: int, out: str) -> DataFrame:
    """Linearly weighted sum of close - open, newest first, over n * n."""
    total, n = linear_weighted(F.col("close") - F.col("open"), p)
    return add(df, out, total / n / n)


def bar_sum3(df: DataFrame, p: int, norm: int, smooth: int, out: str) -> DataFrame:
    """As bar_sum2 in units of a tenth of the tallest body among norm bars, smoothed by triangular_ma where smooth > 1."""
    total, n = linear_weighted(F.col("close") - F.col("open"), p)
    df = df.withColumn("_body", S.wax_height())
    df = add(df, out if smooth <= 1 else "_bars", F.coalesce(F.try_divide(total / n / n * 10, F.max("_body").over(W.last(norm))), F.lit(0.0)), "_body")
    return df if smooth <= 1 else triangular_ma(df, "_bars", smooth, out).drop("_bars")


def triangular_ma(df: DataFrame, x: str, p: int, out: str) -> DataFrame:
    """Sum of (n - i) x over n * n; the weights don't sum to 1."""
    total, n = linear_weighted(F.col(x), p)
    return add(df, out, total / (n * n))


def parabolic_ma(df: DataFrame, x: str, p: int, out: str) -> DataFrame:
    """Sum of ((n - i) / n)^2 x over p."""
    parts = [F.pow((F.least(F.col("pos") + 1, F.lit(p)) - i).cast("double"), 2.0) * W.lagged(x, i) for i in range(p)]
    n = F.least(F.col("pos") + 1, F.lit(p)).cast("double")
    return add(df, out, sum((F.when(F.col("pos") >= i, part).otherwise(0.0) for i, part in enumerate(parts)), F.lit(0.0)) / (n * n) / p)


def common_color(df: DataFrame, p: int, out: str) -> DataFrame:
    """Colour of most of p bars, 1 or -1; a tie has the current bar's."""
    s = F.sum(W.green()).over(W.last(p))
    return add(df, out, F.when(s > 0, 1.0).when(s < 0, -1.0).otherwise(W.green().cast("double")))


def fitted(x: str, p: int) -> tuple[Column, Column, Column]:
    """Slope, mean of x, mean of pos over p rows."""
    pos = F.col("pos").cast("double")
    return F.regr_slope(F.col(x), pos).over(W.last(p)), F.avg(x).over(W.last(p)), F.avg(pos).over(W.last(p))


def lin_reg(df: DataFrame, x: str, p: int, forecast: int, out: str) -> DataFrame:
    """Least-squares line over p rows, at the current row + forecast; x where there is one row."""
    slope, mean, middle = fitted(x, p)
    return add(df, out, F.when(F.least(F.col("pos") + 1, F.lit(p)) < 2, F.col(x)).otherwise(mean + slope * (F.col("pos") + forecast - middle)))


def lin_reg_slope(df: DataFrame, x: str, p: int, out: str) -> DataFrame:
    """Slope over p rows; x itself in the first row."""
    return add(df, out, F.when(F.col("pos") == 0, F.col(x)).otherwise(fitted(x, p)[0]))


def r_squared(df: DataFrame, x: str, p: int, out: str) -> DataFrame:
    """Squared correlation with time over p rows; 0 while there are fewer, or where x is flat."""
    pos = F.col("pos").cast("double")
    flat = F.max(x).over(W.last(p)) == F.min(x).over(W.last(p))
    return add(df, out, F.when((F.col("pos") < p - 1) | flat, 0.0).otherwise(F.coalesce(F.regr_r2(F.col(x), pos).over(W.last(p)), F.lit(0.0))))


def fosc(df: DataFrame, x: str, p: int, out: str) -> DataFrame:
    """100 (x - line at the current row) / x; null where x is 0."""
    return add(lin_reg(df, x, p, 0, "_line"), out, F.try_divide(100 * (F.col(x) - F.col("_line")), F.col(x)), "_line")


def derivative(df: DataFrame, x: str, out: str) -> DataFrame:
    return add(df, out, F.coalesce(F.col(x) - W.lagged(x, 1), F.lit(0.0)))


def integral(df: DataFrame, x: str, c: float, out: str) -> DataFrame:
    return affine(df, 1.0, {out: F.col(x).cast("double")}, F.col("pos") == 0).withColumn(out, F.col(out) + c)


def percent_return(df: DataFrame, x: str, out: str, scale: float = 1.0) -> DataFrame:
    """(x - previous) / previous, 0 in the first row, null after a 0."""
    old = W.lagged(x, 1)
    return add(df, out, F.when(F.col("pos") == 0, 0.0).otherwise(F.try_divide(F.col(x) - old, old) * scale))


def extrapolate(df: DataFrame, x: str, out: str) -> DataFrame:
    """Twice the previous value less the one before it; the first value in the first two rows."""
    return add(df, out, F.when(F.col("pos") < 2, F.first(x).over(W.so_far())).otherwise(2 * W.lagged(x, 1) - W.lagged(x, 2)))


def normalize_sma(df: DataFrame, x: str, p: int, out: str, mode: str = "compat") -> DataFrame:
    """100 (x - average) / average; 0 where the average is 0."""
    return add(sma(df, x, p, "_sma", mode), out, F.coalesce(F.try_divide(100 * (F.col(x) - F.col("_sma")), F.col("_sma")), F.lit(0.0)), "_sma")


def normalize_unit(df: DataFrame, x: str, out: str, fit_on: Column | None = None) -> DataFrame:
    """(x - min) / (max - min) over the whole series, or over its rows with fit_on; null where flat."""
    y = F.col(x) if fit_on is None else F.when(fit_on, F.col(x))
    df = W.with_totals(df, _low=F.min(y), _high=F.max(y))
    return add(df, out, F.try_divide(F.col(x) - F.col("_low"), F.col("_high") - F.col("_low")), "_low", "_high")


def back_bars(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """The last n values, newest first."""
    return add(df, out, F.reverse(F.collect_list(x).over(W.last(n))))


def delay(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Columns shifted n rows later; the first n rows go."""
    shifted = df.withColumns({c: W.lagged(c, n) for c in columns})
    return shifted.where(F.col("pos") >= n)


def sliding_examples(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Every window of n consecutive values, oldest first."""
    return add(df, out, F.collect_list(x).over(W.last(n))).where(F.col("pos") >= n - 1)


def ratio_inputs(df: DataFrame) -> DataFrame:
    """Adds inputs [open, previous open, low, high, close] over the previous open, and up: close > open. The first row goes."""
    base = W.lagged("open", 1)
    parts = [F.col("open"), base, W.lagged("low", 1), W.lagged("high", 1), W.lagged("close", 1)]
    df = df.withColumn("inputs", F.array(*[F.try_divide(c, base) for c in parts])).withColumn("up", (F.col("close") > F.col("open")).cast("int"))
    return df.where(F.col("pos") >= 1)


def close_direction(df: DataFrame, out: str) -> DataFrame:
    """1 where the close is not below the previous one, else -1; 0 in the first row."""
    change = F.col("close") - W.lagged("close", 1)
    return add(df, out, F.when(change.isNull(), 0).when(change >= 0, 1).otherwise(-1))


def next_close_label(df: DataFrame, out: str) -> DataFrame:
    """The next row's close_direction; null in the last row."""
    change = F.lead("close", 1).over(W.line()) - F.col("close")
    return add(df, out, F.when(change >= 0, 1).when(change < 0, -1))


def running_std(df: DataFrame, x: str, p: int, out: str) -> DataFrame:
    return add(df, out, F.stddev_pop(x).over(W.last(p)))


def swing(df: DataFrame, strength: int, high: str, out: str, side: str = "high", revise: bool = False, block: int = ROWS) -> DataFrame:
    """Swing level: a pivot s rows back counts once s rows on its left are strictly beyond it and s on its right not past it.

    It holds until a row passes it, then there is none until the next pivot. Before 2s + 1 rows it is 0; before the first
    pivot a high has none and a low is 0. revise shows a pivot from its own row on rather than from its confirmation.
    """
    s, sign = strength, 1 if side == "high" else -1
    line = W.line()

    def mark(d: DataFrame) -> DataFrame:
        d = d.withColumn("_x", F.col(high) * sign)
        middle = F.lag("_x", s).over(line)
        left, right = F.max("_x").over(line.rowsBetween(-2 * s, -s - 1)), F.max("_x").over(line.rowsBetween(-s + 1, 0))
        d = d.withColumn("_pivot", F.when((F.col("pos") >= 2 * s) & (middle > left) & (middle >= right), middle))
        return d.withColumn("_ahead", F.last("_pivot", ignorenulls=True).over(line.rowsBetween(0, s))) if revise else d

    # In a block: the last pivot, and the highest row since it or since the block's beginning; then what blocks before hold.
    rows = halo(df, 2 * s, max(block, 3 * s), mark, s).withColumn("_block", F.expr(f"pos div {block}"))
    inside = Window.partitionBy("symbol", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_id", F.count("_pivot").over(inside)).withColumn("_own", F.last("_pivot", ignorenulls=True).over(inside))
    since = Window.partitionBy("symbol", "_block", "_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_top", F.max("_x").over(since))
    ends = rows.groupBy("symbol", "_block").agg(*[F.max_by(c, "pos").alias(c) for c in ("_id", "_own", "_top")])
    blocks = Window.partitionBy("symbol").orderBy("_block")
    ends = ends.withColumn("_run", F.count("_own").over(blocks.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("_top", F.max("_top").over(Window.partitionBy("symbol", "_run").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("_own", F.last("_own", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, 0)))
    before = ends.select("symbol", "_block", F.lag("_own").over(blocks).alias("_old"), F.lag("_top").over(blocks).alias("_old_top"))
    rows = rows.join(before, ["symbol", "_block"], "left").withColumn("_level", F.coalesce("_own", "_old"))
    top = F.when(F.col("_id") > 0, F.col("_top")).otherwise(F.greatest("_top", "_old_top"))
    none = F.lit(None).cast("double") if side == "high" else F.lit(0.0)
    value = F.when(F.col("pos") < 2 * s, 0.0).when(F.col("_level").isNull(), none).when(top <= F.col("_level"), F.col("_level") * sign)
    if revise:
        value = F.coalesce(F.col("_ahead") * sign, value)
    return rows.withColumn(out, value).select(*df.columns, out)
