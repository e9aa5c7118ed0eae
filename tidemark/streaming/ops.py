"""Structured Streaming twins: bars, running means and averages, routing, progress, ledgers.

State is one record a key in the state store: the last values a window needs, the last average, or the ledgers of a bucket of accounts.
Rows of a series that come in a later batch than one after them in order of (ts, id) are counted as late and change nothing;
rows of one batch are never late to each other.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.trading import LEDGER, LEDGER_ORDER, Ledger, ledger_rows
from tidemark.sources.bars import Handler, dispatched
from tidemark.sources.sinks import store_append


def stream_bars(ticks: DataFrame, symbol: str, price: str, tie: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Ticks (ts timestamp, ...) to bars by tumbling window; a bar comes out once the watermark passes it."""
    at = F.struct("ts", tie)
    grouped = ticks.withWatermark("ts", delay).groupBy(F.window("ts", width), F.col(symbol).alias("symbol"))
    bars = grouped.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(F.lit(1)).alias("volume"))
    return bars.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def ingest_new(bars: DataFrame, high_water: str, delay: str = "3 days") -> DataFrame:
    """Bars after the mark, each (symbol, ts) once however often it is delivered within the delay."""
    return bars.where(F.col("ts") > F.lit(high_water).cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])


#: Only this store keeps state by transformWithState.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VALUES = "symbol string, ts timestamp, id bigint, value double, late boolean, n_late bigint"

#: f(last, xs): values of new rows xs after the values kept from earlier ones, and what is kept then.
Fold = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class Running(StatefulProcessor):
    """A fold over each series in order of (ts, id): what the fold keeps, the last place seen and the late rows so far.

    A trigger's rows of a series are held as three arrays of numbers and folded at once, so the trigger's size bounds them.
    """

    def __init__(self, fold: Fold, ttl_ms: int | None):
        self.fold, self.ttl_ms = fold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", "kept array<double>, ts bigint, id bigint, n_late bigint", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        parts = [(b["ts"].to_numpy("datetime64[us]").astype(np.int64), b["id"].to_numpy(np.int64), b["x"].to_numpy(np.float64)) for b in rows]
        ts, ids, xs = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((ids, ts))
        ts, ids, xs = ts[order], ids[order], xs[order]
        kept, at, last, n_late = self.state.get() if self.state.exists() else ([], None, None, 0)
        late = np.zeros(len(ts), bool) if at is None else (ts < at) | (ts == at) & (ids < last)
        values = np.full(len(ts), np.nan)
        kept = np.array(kept, np.float64)
        if not late.all():
            values[~late], kept = self.fold(kept, xs[~late])
            at, last = int(ts[-1]), int(ids[-1])  # a row that is not late sorts after all that are
        self.state.update((kept.tolist(), at, last, int(n_late + late.sum())))
        out = pd.DataFrame({"symbol": key[0], "ts": ts.astype("datetime64[us]"), "id": ids, "value": values, "late": late, "n_late": n_late + np.cumsum(late)})
        for start in range(0, len(out), 65536):
            yield out.iloc[start : start + 65536]

    def close(self) -> None:
        pass


def per_series(rows: DataFrame, fold: Fold, ttl: str | None = None) -> DataFrame:
    """(symbol, ts, id, value, late, n_late) of a stream (symbol, ts, id, x), one row each.

    A row whose (ts, id) is before one of an earlier trigger is late: it has no value (NaN) and changes nothing but the
    series' count of late rows, n_late. ttl: what is kept of a series goes when it gets no row for so long ("30 days");
    such a stream looks for what to drop in every trigger, so it needs a processing-time trigger: availableNow doesn't end.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keyed = rows.select("symbol", "ts", F.col("id").cast("bigint").alias("id"), F.col("x").cast("double").alias("x")).groupBy("symbol")
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None
    return keyed.transformWithStateInPandas(Running(fold, ttl_ms), VALUES, "append", "ProcessingTime" if ttl else "None")


def over_last(p: int, figure: Callable[[np.ndarray], np.ndarray]) -> Fold:
    """figure (along the last axis) of each row and the p - 1 before it, fewer at the start of a series."""

    def fold(kept: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        line = np.concatenate([kept, xs])
        head = [figure(line[: i + 1]) for i in range(len(kept), min(p - 1, len(line)))]
        tail = [figure(sliding_window_view(line[i : i + 65536 + p - 1], p)) for i in range(0, len(line) - p + 1, 65536)]
        return np.concatenate([np.array(head, np.float64), *tail]), line[max(0, len(line) - p + 1) :]

    return fold


def stream_mean(rows: DataFrame, p: int, ttl: str | None = None) -> DataFrame:
    return per_series(rows, over_last(p, lambda x: x.mean(axis=-1)), ttl)


def stream_std(rows: DataFrame, p: int, ttl: str | None = None) -> DataFrame:
    return per_series(rows, over_last(p, lambda x: x.std(axis=-1)), ttl)


def stream_ema(rows: DataFrame, p: int, ttl: str | None = None) -> DataFrame:
    def fold(kept: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        line = pd.Series(np.concatenate([kept, xs])).ewm(alpha=2 / (1 + p), adjust=False).mean().to_numpy()
        return line[len(kept) :], line[-1:]

    return per_series(rows, fold, ttl)


def stream_progress(notes: DataFrame, total: int, delay: str = "1 day") -> DataFrame:
    """Completed items and their share, each (mixture, ord) counted once however often it is delivered within the delay.

    notes: (ts, mixture, ord). What is remembered of an item ends with the delay.
    """
    done = notes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["mixture", "ord"])
    return done.groupBy().agg(F.count(F.lit(1)).alias("completed")).withColumn("share", F.col("completed") / total)


def route(messages: DataFrame, text: str, handlers: list[Handler], path: str, checkpoint: str, default: str | None = None):
    """Dispatch a stream of messages to one store a route, typed, and what no handler takes to `unknown` with its error.

    A store holds the stream's other columns and the record's (unknown: the text and the error); sinks.store_read reads it.
    Each trigger is one batch of each store, by its id, so a trigger that runs again after a failure half-way changes only
    the stores it had not reached.
    """
    others = [c for c in messages.columns if c != text]

    def deliver(batch: DataFrame, epoch: int) -> None:
        routed = dispatched(batch, text, handlers, default).persist()
        try:
            for name in dict.fromkeys(h.route for h in handlers):
                store_append(routed.where(F.col("route") == name).select(*others, f"`{name}`"), f"{path}/{name}", f"batch-{epoch}", None)
            store_append(routed.where("route = 'unknown'").select(*others, text, "error"), f"{path}/unknown", f"batch-{epoch}", None)
        finally:
            routed.unpersist()

    return messages.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)


def stream_ledger(orders: DataFrame, initial: float, margin: float, cost: float, buckets: int = 4096) -> DataFrame:
    """operators.trading.position_ledger on a stream of orders, in order of seq within a batch; state is the accounts' ledgers.

    Accounts go through Python, and are kept, by bucket of their hash, as calls by account cost more than their orders.
    A trigger's orders of a bucket are held at once.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ledgers = {account: Ledger(equity, margin, cost, {s: (n, c) for s, n, c in held}) for account, equity, held in json.loads(state.get[0])} if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable").sort_values("account", kind="stable")
        out, _, _ = ledger_rows(rows, lambda account: ledgers.setdefault(account, Ledger(initial, margin, cost)))
        state.update((json.dumps([(a, o.equity, [(s, n, c) for s, (n, c) in o.positions.items()]) for a, o in ledgers.items()]),))
        for start in range(0, len(out), 65536):
            yield out.iloc[start : start + 65536]

    keyed = orders.select(*LEDGER_ORDER, F.pmod(F.xxhash64("account"), F.lit(buckets)).alias("bucket")).groupBy("bucket")
    return keyed.applyInPandasWithState(fold, LEDGER, "state string", "append", GroupStateTimeout.NoTimeout)
