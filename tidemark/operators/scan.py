"""Recurrences v = a * v' + b along a series, without a task ever holding a whole series.

A recurrence with 0 < a < 1 forgets: what lies `memory(a)` rows back weighs less than a double can show. So it is computed
in buckets that overlap by that many rows (halo), in each by plain windows: B = a^k * sum(b_j / a^j) from the bucket's
start. Several recurrences share one pass, and windows before and after them the same buckets.

Where nothing is forgotten (a = 1), or blocks of a given length are asked for, steps are composed instead: (a2, b2) after
(a1, b1) is (a1 a2, a2 b1 + b2). One row a block goes to a carry table, where a block's starting value is composed from the
blocks before it, and comes back by a join on (symbol, block). A row then holds A * carry + B.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import frames as W
from tidemark.operators.halo import dealt, halo

BLOCK = 1 << 16


def memory(a: float) -> int:
    """Rows after which a value's weight is below 1e-21."""
    return math.ceil(50 / -math.log(a))


def longest(a: float) -> int:
    """Rows that a bucket may have so that a ** -k stays finite."""
    return int(math.log(1e250) / -math.log(a))


def spread(df: DataFrame, reach: int, factors: Iterable[float], operator: Callable[[DataFrame], DataFrame], block: int | None = None) -> DataFrame:
    """operator(df), which computes recurrences with these factors and looks back `reach` rows besides, in buckets.

    Rows that are in buckets already, that are asked for in blocks, or whose factors differ so much that no length of bucket
    suits all, go to the operator as they are.
    """
    factors = [a for a in factors if a > 0]
    if dealt(df) or block is not None or any(a >= 1 for a in factors):
        return operator(df)
    back = reach + max(map(memory, factors), default=0)
    rows = min((longest(a) for a in factors), default=BLOCK) - back
    return halo(df, back, rows, operator) if rows >= 2 * back else operator(df)


def fading(df: DataFrame, a: float, steps: dict[str, Column], start: Column) -> DataFrame:
    """affine on series of at most `longest(a)` rows by plain windows."""
    rows = df.withColumn("_k", F.col("pos") - F.first("pos").over(W.so_far())).withColumn("_start", start)
    rows = rows.withColumn("_from", F.coalesce(F.max(F.when(F.col("_start"), F.col("_k"))).over(W.so_far()), F.lit(-1)))
    rows = rows.withColumns({f"_b_{n}": b for n, b in steps.items()})
    since = lambda n: F.sum(F.when(F.col("_start"), 0.0).otherwise(F.col(f"_b_{n}") * F.pow(F.lit(a), -F.col("_k")))).over(W.so_far())
    head = lambda n: F.last(F.when(F.col("_start"), F.col(f"_b_{n}")), ignorenulls=True).over(W.so_far())
    rows = rows.withColumns({f"_s_{n}": since(n) for n in steps} | {f"_h_{n}": head(n) for n in steps})
    own = lambda n: F.pow(F.lit(a), F.col("_k")) * F.col(f"_s_{n}")
    early = lambda n: F.pow(F.lit(a), F.col("_k") - F.col("_from")) * F.col(f"_h_{n}")
    rows = rows.withColumns({n: F.when(F.col("_from") >= 0, early(n) + own(n)).otherwise(own(n)) for n in steps})
    return rows.drop("_k", "_start", "_from", *[f"_{x}_{n}" for n in steps for x in "bsh"])


def affine(df: DataFrame, a: float, steps: dict[str, Column], start: Column, block: int | None = None) -> DataFrame:
    """Adds for each name v = b where start is true, else a * v' + b. df: (symbol, ts, pos, ...); steps: name -> b.

    0 <= a <= 1. start must hold at least in each series' first row, and only at its beginning (pos below some number).
    """
    if a == 0:
        return df.withColumns(steps)
    if dealt(df):
        return fading(df, a, steps, start)
    if a < 1 and block is None:
        return halo(df, memory(a), longest(a) - memory(a), lambda d: fading(d, a, steps, start))
    block = block or BLOCK
    while a**block < 1e-250:  # so that a ** -k stays finite
        block //= 2
    rows = df.withColumn("_block", F.expr(f"pos div {block}")).withColumn("_start", start)
    inside = Window.partitionBy("symbol", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    k = F.col("pos") % block  # place in the block
    # Rows up to the last start in the block hold b alone; what follows counts from it.
    rows = rows.withColumn("_from", F.coalesce(F.max(F.when(F.col("_start"), F.col("pos") % block)).over(inside), F.lit(-1)))
    for name, b in steps.items():
        rows = rows.withColumn(f"_b_{name}", b)
    for name in steps:
        since = F.when(F.col("_start"), 0.0).otherwise(F.col(f"_b_{name}") * F.pow(F.lit(a), -k))
        head = F.last(F.when(F.col("_start"), F.col(f"_b_{name}")), ignorenulls=True).over(inside)
        # start rows only lie at a series' beginning: the sum over the block holds no row from before the last of them
        own = F.pow(F.lit(a), k) * F.sum(since).over(inside)
        early = F.pow(F.lit(a), k - F.col("_from")) * head
        rows = rows.withColumn(f"_B_{name}", F.when(F.col("_from") >= 0, early + own).otherwise(own))
    rows = rows.withColumn("_A", F.when(F.col("_from") >= 0, 0.0).otherwise(F.pow(F.lit(a), k + 1)))
    ends = rows.groupBy("symbol", "_block").agg(*[F.max_by(c, "pos").alias(c) for c in ("_A", *[f"_B_{n}" for n in steps])])
    carries = carried(ends, list(steps), a, block)
    rows = rows.join(carries, ["symbol", "_block"], "left")
    values = {n: F.coalesce(F.col("_A") * F.col(f"_C_{n}"), F.lit(0.0)) + F.col(f"_B_{n}") for n in steps}
    return rows.withColumns(values).drop("_block", "_start", "_from", "_A", *[f"_{x}_{n}" for n in steps for x in "bBC"])


def carried(ends: DataFrame, names: list[str], a: float, block: int) -> DataFrame:
    """(symbol, _block, _C_name): the value each block starts from, composed from the blocks before it."""
    line = Window.partitionBy("symbol").orderBy("_block")
    reach = 1 + math.ceil(-50 / (block * math.log(a))) if a < 1 else BLOCK
    if reach <= 1 << 10:  # as far back as blocks count in double precision
        back = line.rowsBetween(-reach, -1)
        value = lambda n: F.aggregate(F.collect_list(F.struct("_A", f"_B_{n}")).over(back), F.lit(0.0), lambda v, s: s["_A"] * v + s[f"_B_{n}"])
    else:  # a is 1, or so near that its powers stay finite over the whole series
        back = line.rowsBetween(Window.unboundedPreceding, -1)
        power = lambda k: F.pow(F.lit(float(a)), k * block)
        value = lambda n: F.coalesce(F.sum(F.col(f"_B_{n}") * power(-F.col("_block") - 1)).over(back), F.lit(0.0)) * power(F.col("_block"))
    return ends.select("symbol", "_block", *[value(n).alias(f"_C_{n}") for n in names])
