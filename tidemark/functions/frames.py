"""Window frames of a series: rows of a symbol in order of time. All end at the current row; none looks ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def line() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def last(p: int) -> WindowSpec:
    """The current row and the p - 1 before it."""
    return line().rowsBetween(-(p - 1), 0)


def before(p: int) -> WindowSpec:
    """The p rows before the current one."""
    return line().rowsBetween(-p, -1)


def so_far() -> WindowSpec:
    return line().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    return Window.partitionBy("symbol")


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """Adds aggregates of the whole series, combined before the shuffle."""
    return df.join(df.groupBy("symbol").agg(*[c.alias(name) for name, c in totals.items()]), "symbol")


def month() -> Column:
    return F.date_trunc("month", "ts")


def bucket_of(df: DataFrame, most: int = 1 << 16) -> Column:
    """The widest bucket of time that holds at most `most` rows of a symbol, for with_pos and with_folds on dense series.

    It counts rows by symbol and month, and by shorter units only where a month holds too many (a count each, combined
    before the shuffle). Where even a second does, seconds it is.
    """
    for unit in ("month", "day", "hour", "minute"):
        counts = df.groupBy("symbol", F.date_trunc(unit, "ts")).agg(F.count(F.lit(1)).alias("n"))
        if (counts.agg(F.max("n")).first()[0] or 0) <= most:
            return F.date_trunc(unit, "ts")
    return F.date_trunc("second", "ts")


def with_folds(df: DataFrame, bucket: Column | None = None, **folds: tuple[str, Column]) -> DataFrame:
    """Adds running folds of a series: ("sum" | "max" | "last", value) over the rows up to the current one, nulls left out.

    A fold runs inside buckets of time (months, or as given; bucket_of chooses for dense series), whose totals are put
    together beside, so that no task holds a series.
    """
    rows = df.withColumn("_bucket", month() if bucket is None else bucket).withColumns({f"_x_{n}": x for n, (_, x) in folds.items()})
    inside = Window.partitionBy("symbol", "_bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("symbol").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": lambda c, w: F.sum(c).over(w), "max": lambda c, w: F.max(c).over(w), "last": lambda c, w: F.last(c, ignorenulls=True).over(w)}
    total = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))}
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(b, a)}
    totals = rows.groupBy("symbol", "_bucket").agg(*[total[kind](f"_x_{n}").alias(n) for n, (kind, _) in folds.items()])
    totals = totals.select("symbol", "_bucket", *[over[kind](n, before).alias(f"_old_{n}") for n, (kind, _) in folds.items()])
    rows = rows.withColumns({f"_own_{n}": over[kind](f"_x_{n}", inside) for n, (kind, _) in folds.items()}).join(totals, ["symbol", "_bucket"])
    return rows.select(*[c for c in df.columns if c not in folds], *[both[kind](F.col(f"_old_{n}"), F.col(f"_own_{n}")).alias(n) for n, (kind, _) in folds.items()])


def with_pos(df: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Adds pos, the row's place in its series from 0.

    Rows are numbered inside buckets of time (months, or as given: a bucket must grow with ts; bucket_of chooses for dense
    series), whose sizes are summed up beside, so that no task holds a series.
    """
    rows = df.withColumn("_bucket", month() if bucket is None else bucket)
    sizes = rows.groupBy("symbol", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("symbol").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("symbol", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("symbol", "_bucket").orderBy("ts")
    placed = rows.withColumn("_in", F.row_number().over(inside)).join(starts, ["symbol", "_bucket"])
    return placed.withColumn("pos", F.col("_start") + F.col("_in") - 1).select(*df.columns, "pos")


def lagged(x: str | Column, n: int) -> Column:
    return F.lag(x, n).over(line())


def green(sign: bool = True) -> Column:
    up = F.col("close") >= F.col("open")
    return F.when(up, 1).otherwise(-1) if sign else up
