"""Aligning, joining, slicing and splitting series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import frames as W
from tidemark.functions import scalar as S

FIELDS = ("open", "high", "low", "close", "volume")


def align_calendar(bars: DataFrame, symbol: str, others: list[str]) -> DataFrame:
    """Every other series on the dates of one symbol; rows on dates it lacks are dropped, not carried.

    A missing date repeats the last filled row, leading gaps the first matched one; filled rows have filled = true.
    """
    calendar = bars.where(F.col("symbol") == symbol).select("ts")
    names = F.array(*[F.lit(s) for s in others])
    grid = calendar.select(F.explode(names).alias("symbol"), "ts")
    rows = grid.join(bars.where(F.col("symbol").isin(others)).withColumn("_bar", F.struct(*FIELDS)), ["symbol", "ts"], "left")
    rows = W.with_folds(rows, _back=("last", F.col("_bar")))
    first = rows.groupBy("symbol").agg(F.min_by("_bar", F.when(F.col("_bar").isNotNull(), F.col("ts"))).alias("_first"))
    filled = rows.join(first, "symbol").select("symbol", "ts", F.coalesce("_back", "_first").alias("b"), F.col("_bar").isNull().alias("filled"))
    return filled.select("symbol", "ts", *[F.col(f"b.{c}").alias(c) for c in FIELDS], "filled")


def zip_series(left: DataFrame, right: DataFrame, x: str, y: str) -> DataFrame:
    """Positional zip of two series (pos, ...): (pos, x, y). The query fails if their lengths differ."""
    a, b = left.select("pos", F.col(x).alias("x")), right.select("pos", F.col(y).alias("y"))
    rows = a.join(b, "pos", "full")
    return rows.withColumn("x", F.when(F.col("x").isNull() | F.col("y").isNull(), F.raise_error("series of equal length are asked for")).otherwise(F.col("x")))


def mesh(bars: DataFrame, x: str = "close") -> DataFrame:
    """Ordered outer merge of all series: for each ts the series present with their values, by symbol."""
    return bars.groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("symbol", F.col(x).alias("value")))).alias("present"))


def series_extents(bars: DataFrame) -> DataFrame:
    """(symbol, left, right): slots of each series' first row and its last on the merged axis, counted from its own length."""
    slots = W.with_pos(bars.select(F.lit("").alias("symbol"), "ts").distinct()).select("ts", F.col("pos").alias("slot"))
    rows = bars.join(slots, "ts").groupBy("symbol").agg(F.min("slot").cast("long").alias("left"), F.count(F.lit(1)).alias("n"))
    return rows.select("symbol", "left", (F.col("left") + F.col("n") - 1).alias("right"))


def crop_with_margin(bars: DataFrame, start: str, end: str, before: int = 100, after: int = 7) -> DataFrame:
    """Dates start - before days to end + after days, for warm-up and labels. Filters by ts alone, so it reaches the scan."""
    low, high = F.date_sub(F.to_date(F.lit(start)), before), F.date_add(F.to_date(F.lit(end)), after)
    return bars.where((F.col("ts") >= low.cast("timestamp_ntz")) & (F.col("ts") <= high.cast("timestamp_ntz")))


def date_range(bars: DataFrame, start: str, end: str) -> DataFrame:
    return bars.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def index_window(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Rows (with pos) from the first one on or after start to the last one on or before end, by place."""
    on = lambda s: F.lit(s).cast("timestamp_ntz")
    first = F.min(F.when(F.col("ts") >= on(start), F.col("pos")))
    last = F.max(F.when(F.col("ts") <= on(end), F.col("pos")))
    return W.with_totals(bars, _a=first, _b=last).where(F.col("pos").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def fraction_window(bars: DataFrame, offset: float, size: float) -> DataFrame:
    """floor(size n) rows, one at least, from place floor(offset n), within the series."""
    rows = W.with_totals(bars, _n=F.count(F.lit(1)))
    rows = rows.withColumn("_start", F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(offset)))))
    length = F.greatest(F.lit(1), F.least(F.col("_n") - F.col("_start"), F.floor(F.col("_n") * F.lit(size))))
    return rows.where((F.col("pos") >= F.col("_start")) & (F.col("pos") < F.col("_start") + length)).drop("_n", "_start")


def trim_value(df: DataFrame, x: str, v: float) -> DataFrame:
    """Drop leading and trailing rows equal to v; a series of nothing else goes."""
    kept = F.when(~F.col(x).eqNullSafe(F.lit(v)), F.col("ts"))
    return W.with_totals(df, _a=F.min(kept), _b=F.max(kept)).where("ts >= _a and ts <= _b").drop("_a", "_b")


def split_by_date(bars: DataFrame, start: str, end: str, validation: float) -> DataFrame:
    """Adds part: train up to start + (end - start)(1 - validation) in whole days, validation from the day after."""
    a, b = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    split = F.date_add(a, F.floor(F.datediff(b, a) * F.lit(1 - validation)).cast("int"))
    rows = date_range(bars, start, end)
    return rows.withColumn("part", F.when(F.to_date("ts") <= split, "train").otherwise("validation"))


def split_by_rows(bars: DataFrame, parts: int) -> DataFrame:
    """Adds part 0..parts-1: slices of floor(n / parts) rows, the last with the remainder."""
    each = F.greatest(F.lit(1), F.floor(F.col("_n") / parts))
    rows = W.with_totals(bars, _n=F.count(F.lit(1)))
    return rows.withColumn("part", F.least(F.floor(F.col("pos") / each), F.lit(parts - 1)).cast("int")).drop("_n")


def train_share(bars: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds train: whether a row is among the first floor(share n)."""
    rows = W.with_totals(bars, _n=F.count(F.lit(1)))
    return rows.withColumn("train", F.col("pos") < F.floor(F.col("_n") * F.lit(share))).drop("_n")


def from_first_signal(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Bars from each symbol's first signal on, with its signal (symbol, ts, signal)."""
    first = signals.groupBy("symbol").agg(F.min("ts").alias("_first"))
    rows = bars.join(first, "symbol").where("ts >= _first").drop("_first")
    return rows.join(signals.select("symbol", "ts", "signal"), ["symbol", "ts"])


def reject_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """df; the query fails where one of the columns is NaN."""
    bad = F.exists(F.array(*[F.isnan(c) for c in columns]), lambda x: F.coalesce(x, F.lit(False)))
    return df.where(F.when(bad, F.raise_error("a feature is NaN")).otherwise(F.lit(True)).cast("boolean"))


def interleave(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (pos, value) of two lists in turn, then the tail of the longer: adds place."""
    both = a.withColumn("source", F.lit(0)).unionByName(b.withColumn("source", F.lit(1)))
    length = lambda s: F.coalesce(F.max(F.when(F.col("source") == s, F.col("pos") + 1)), F.lit(0))
    both = both.crossJoin(F.broadcast(both.agg(F.least(length(0), length(1)).alias("_shorter"))))  # one row
    place = F.when(F.col("pos") < F.col("_shorter"), 2 * F.col("pos") + F.col("source")).otherwise(F.col("_shorter") + F.col("pos"))
    return both.withColumn("place", place).drop("_shorter")


def month_first(bars: DataFrame) -> DataFrame:
    """First ts present in each month, the first month of a series left out."""
    months = bars.groupBy("symbol", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.min("ts").alias("first_ts"))
    return months.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy("month"))).where("_k > 1").drop("_k")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df in an order that depends on the key and seed alone."""
    return df.orderBy(S.uniform(seed, 0.0, 1.0, key), key)


def visible_bounds(bars: DataFrame, condition: Column) -> DataFrame:
    """(symbol, low, high) of the rows with a condition, NaN left out; 0 and 0 where nothing is left."""
    use = lambda c: F.when(condition & ~F.isnan(c), F.col(c))
    return bars.groupBy("symbol").agg(F.coalesce(F.min(use("low")), F.lit(0.0)).alias("low"), F.coalesce(F.max(use("high")), F.lit(0.0)).alias("high"))
