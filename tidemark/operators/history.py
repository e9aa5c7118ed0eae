"""Operators given by a user's own Python function of a series and its history."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from tidemark.operators import series
from tidemark.operators.halo import ROWS, halo

#: Parameters -> the rows a strategy looks back on, and bars with pos -> bars with a `signal`.
Strategy = Callable[..., tuple[int, Callable[[DataFrame], DataFrame]]]
STRATEGIES: dict[str, Strategy] = {}


def map_with_history(df: DataFrame, columns: list[str], begin: Callable[[], Any], step: Callable[..., tuple[Any, float]], out: str) -> DataFrame:
    """(symbol, ts, out): step(state, *values) -> (state, value) over each series in order of ts.

    A series streams through its task in Arrow batches; only the state is held, never the series.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, state = None, None
        for batch in batches:
            values = []
            for s, *row in zip(batch["symbol"], *[batch[c] for c in columns], strict=True):
                if s != symbol:
                    symbol, state = s, begin()
                state, value = step(state, *row)
                values.append(value)
            yield batch[["symbol", "ts"]].assign(**{out: values})

    rows = df.select("symbol", "ts", *columns).repartition("symbol").sortWithinPartitions("symbol", "ts")
    return rows.mapInPandas(fold, f"symbol string, ts timestamp_ntz, {out} double")


def map_blocks(
    df: DataFrame, columns: list[str], begin: Callable[[], Any], step: Callable[..., Any], merge: Callable[[Any, Any], Any], value: Callable[..., float], out: str, rows: int = ROWS
) -> DataFrame:
    """(symbol, ts, out): value(state, *values) of each row of df (with pos), where state = step(state before, *values).

    A series' blocks of `rows` rows fold apart from begin() and are summed up in a state each (anything JSON holds). States
    of blocks are merged in order, one row a block, into what each block starts from, and blocks fold again from there. So
    merge(a, b) must be the state of b's rows after a's: step(merge(a, b), x) = merge(a, step(b, x)), merge(a, begin()) = a.
    """
    own = df.select("symbol", "ts", F.expr(f"pos div {rows}").alias("block"), (F.col("pos") % rows == 0).alias("first"), *[F.col(c).alias(f"v_{c}") for c in columns])

    def blocks(batches: Iterator[pd.DataFrame], start: Callable[[Any], Any]) -> Iterator[tuple[pd.DataFrame, list, list]]:
        """Each sorted batch with its rows' values, and the states of blocks that ended in it."""
        at, state = None, None
        for batch in batches:
            values, ended = [], []
            for s, block, carry, *row in zip(batch["symbol"], batch["block"], batch["carry"], *[batch[f"v_{c}"] for c in columns], strict=True):
                if (s, block) != at:
                    if at is not None:
                        ended.append((*at, json.dumps(state)))
                    at, state = (s, block), start(carry)
                state = step(state, *row)
                values.append(value(state, *row))
            yield batch, values, ended
        if at is not None:
            yield pd.DataFrame(), [], [(*at, json.dumps(state))]

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, ended in blocks(batches, lambda _: begin()):
            yield pd.DataFrame(ended, columns=["symbol", "block", "state"])

    def carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, state = None, None
        for batch in batches:
            starts = []
            for s, more in zip(batch["symbol"], batch["state"], strict=True):
                if s != symbol:
                    symbol, state = s, begin()
                starts.append(json.dumps(state))
                state = merge(state, json.loads(more))
            yield batch[["symbol", "block"]].assign(carry=starts)

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, values, _ in blocks(batches, lambda carry: json.loads(carry)):
            if len(batch):
                yield batch[["symbol", "ts"]].assign(**{out: values})

    line = lambda d: d.repartition("symbol", "block").sortWithinPartitions("symbol", "block", "ts")
    ends = line(own.withColumn("carry", F.lit(None).cast("string"))).mapInPandas(summed, "symbol string, block bigint, state string")
    carries = ends.repartition("symbol").sortWithinPartitions("symbol", "block").mapInPandas(carried, "symbol string, block bigint, carry string")
    begun = own.join(carries, ["symbol", "block"]).withColumn("carry", F.when(F.col("first"), F.col("carry")))
    return line(begun).mapInPandas(folded, f"symbol string, ts timestamp_ntz, {out} double")


@F.udtf
class Examples:
    """A table function: each row of a series with the last values of x up to it, as many as its own `size` says (or there are).

    It takes a table with symbol, ts, x (double) and size (int), and asks Spark for it by symbol in order of ts itself.
    """

    def __init__(self) -> None:
        self.last: list[float] = []

    @staticmethod
    def analyze(table: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(most.value, int) or most.value < 1:
            raise ValueError("the longest window is a whole number of rows")
        missing = {"symbol", "ts", "x", "size"} - set(table.dataType.fieldNames())
        if missing:
            raise ValueError(f"the table lacks {sorted(missing)}")
        schema = T.StructType([*table.dataType.fields, T.StructField("example", T.ArrayType(T.DoubleType()))])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("symbol")], orderBy=[OrderingColumn("ts")])

    def eval(self, row: Row, most: int) -> Iterator[tuple]:
        self.last.append(row["x"])
        del self.last[:-most]
        yield (*row, self.last[-min(max(1, row["size"]), most) :])


def sized_examples(df: DataFrame, x: str, size: Column, most: int) -> DataFrame:
    """Bars (with pos) with `example`: the last `size` (1 to most) values of x up to each row, oldest first; in buckets."""
    rows = df.withColumns({"x": F.col(x).cast("double"), "size": size.cast("int")})
    return halo(rows, most - 1, ROWS, lambda d: Examples(d.asTable(), F.lit(most))).drop("x", "size")


def zip_with(left: DataFrame, right: DataFrame, x: str, y: str, f: Callable, out: str) -> DataFrame:
    """(symbol, ts, out): f(x, y) of two series joined on (symbol, ts); f takes and gives columns."""
    rows = left.select("symbol", "ts", F.col(x).alias("_x")).join(right.select("symbol", "ts", F.col(y).alias("_y")), ["symbol", "ts"])
    return rows.select("symbol", "ts", f(F.col("_x"), F.col("_y")).alias(out))


def strategy(name: str) -> Callable[[Strategy], Strategy]:
    """Register a strategy by name."""

    def keep(f: Strategy) -> Strategy:
        STRATEGIES[name] = f
        return f

    return keep


@strategy("momentum")
def momentum(period: int) -> tuple[int, Callable[[DataFrame], DataFrame]]:
    return period, lambda df: series.momentum(df, "close", period, "signal")


@strategy("contrarian")
def contrarian(period: int) -> tuple[int, Callable[[DataFrame], DataFrame]]:
    return period, lambda df: series.momentum(df, "close", period, "_m").withColumn("signal", -F.col("_m")).drop("_m")


def make_signal(name: str, **parameters) -> Callable[[DataFrame], DataFrame]:
    """A registered strategy with its parameters, run in buckets that overlap by what it looks back on."""
    reach, operator = STRATEGIES[name](**parameters)
    return lambda df: halo(df, reach, ROWS, operator)
