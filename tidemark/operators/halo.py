"""Windows on series too long for one task: buckets of rows that overlap by what a window looks back on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import frames as W

#: Rows of a bucket where the operator asks for no fewer.
ROWS = 1 << 16


def two_level_pos(df: DataFrame, bucket: Column) -> DataFrame:
    """Adds pos: the row number inside a time bucket plus the rows of the buckets before it. bucket must grow with ts."""
    return W.with_pos(df, bucket)


def dealt(df: DataFrame) -> bool:
    """Whether df's series are already buckets of longer ones."""
    return "_home" in df.columns


def halo(df: DataFrame, reach: int, rows: int, operator: Callable[[DataFrame], DataFrame], ahead: int = 0) -> DataFrame:
    """operator(df) for one that looks back at most `reach` rows and ahead `ahead`, computed in buckets of `rows` rows by pos.

    The last `reach` rows of a bucket are copied to the next one and its first `ahead` rows to the one before, the operator
    runs on (symbol, bucket) as its series, and the copies go. No task holds more than rows + reach + ahead rows of a series.
    In a series' first bucket what the operator says of the first rows holds; df has pos, which stays that of the series.
    """
    if max(reach, ahead) > rows:
        raise ValueError(f"buckets of {rows} rows are shorter than the {max(reach, ahead)} rows that are looked at")
    home, place = F.expr(f"pos div {rows}"), F.col("pos") % rows
    copies = F.array(home, F.when(place >= rows - reach, home + 1), F.when((place < ahead) & (home > 0), home - 1))
    buckets = df.withColumn("_home", home).withColumn("_bucket", F.explode(F.filter(copies, lambda x: x.isNotNull())))
    buckets = buckets.withColumn("_symbol", F.col("symbol")).withColumn("symbol", F.to_json(F.struct("_symbol", "_bucket")))
    done = operator(buckets).where("_home = _bucket")
    return done.withColumn("symbol", F.col("_symbol")).drop("_home", "_bucket", "_symbol")
