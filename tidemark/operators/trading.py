"""Signals to trades, profit, equity, drawdown, reports and ledgers.

Trades of different accounts or symbols are independent, so everything is a window or an aggregate by key. Folds that
depend on their own result (integer shares, average cost) run per key in pandas.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import frames as W
from tidemark.functions import scalar as S
from tidemark.operators import series
from tidemark.operators.halo import ROWS, halo

#: Session times of a bar's day.
OPENS, CLOSES = "interval '9:30' hour to minute", "interval 16 hour"


def signals(df: DataFrame, x: str) -> DataFrame:
    """(symbol, ts, bias, time_of_day, size_pct, stop, limit) from the sign of x."""
    return df.select("symbol", "ts", S.bias(x).alias("bias"), F.lit("Open").alias("time_of_day"), F.lit(1.0).alias("size_pct"), F.lit(None).cast("double").alias("stop"), F.lit(None).cast("double").alias("limit"))


def session_exit(df: DataFrame) -> DataFrame:
    """Bars with side (long or short) and stop: adds entry, exit, unstopped_exit, stopped, entry_time, exit_time.

    Entry is the open; exit the stop if the bar touches it, else the close.
    """
    long = F.col("side") == "long"
    touched = F.coalesce(F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop")), F.lit(False))
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    rows = df.withColumn("entry", F.col("open")).withColumn("stopped", touched).withColumn("unstopped_exit", F.col("close"))
    rows = rows.withColumn("exit", F.when(F.col("stopped"), F.col("stop")).otherwise(F.col("close")))
    return rows.withColumn("entry_time", day + F.expr(OPENS)).withColumn("exit_time", day + F.expr(CLOSES))


def trade_pnl(df: DataFrame, commission: float = 4.95) -> DataFrame:
    """Adds profit: size (exit - entry), negated for short, less two commissions."""
    gain = F.col("size") * (F.col("exit") - F.col("entry"))
    return df.withColumn("profit", F.when(F.col("side") == "long", gain).otherwise(-gain) - 2 * commission)


def equity_curve(df: DataFrame, initial: float) -> DataFrame:
    """Adds value_before and value_after of the account (symbol) around each trade."""
    rows = W.with_folds(df, value_after=("sum", F.col("profit")))
    return rows.withColumn("value_after", F.col("value_after") + initial).withColumn("value_before", F.col("value_after") - F.col("profit"))


def flat(df: DataFrame, gains: bool = False, losses: bool = False) -> DataFrame:
    """What if winning (gains) or losing (losses) trades were left at their entry: profit 0 and exit = entry."""
    off = (F.lit(gains) & (F.col("profit") > 0)) | (F.lit(losses) & (F.col("profit") <= 0))
    return df.withColumns({"exit": F.when(off, F.col("entry")).otherwise(F.col("exit")), "profit": F.when(off, 0.0).otherwise(F.col("profit"))})


def derived(df: DataFrame) -> DataFrame:
    """Adds loss, pct_profit, pct_loss, is_win, is_stopped_gain."""
    return df.withColumns({
        "loss": -F.col("profit"), "pct_profit": F.try_divide(F.col("profit"), F.col("value_before")), "pct_loss": F.try_divide(-F.col("profit"), F.col("value_before")),
        "is_win": F.col("profit") > 0, "is_stopped_gain": F.col("stopped") & (F.col("profit") > 0),
    })


def buying_power_violations(df: DataFrame, margin: float, borrowed: Column) -> DataFrame:
    """Trades whose cost size * entry exceeds value_before * margin - borrowed, with both."""
    rows = df.withColumn("cost", F.col("size") * F.col("entry")).withColumn("power", F.col("value_before") * margin - borrowed)
    return rows.where("cost > power")


def max_shares(equity: Column, margin: float, cost: float, price: Column, invested: Column | None = None) -> Column:
    """Largest whole number of shares that the buying power pays for."""
    return F.floor(((equity - cost) * margin - (F.lit(0.0) if invested is None else invested)) / price)


def trade_report(df: DataFrame, initial: float, charge: float = 9.90) -> DataFrame:
    """One row a symbol of trades with profit, value_before, stopped, side. charge is added to losses for every trade.

    total_return is the last value over the first (1: flat). Ratios without a denominator are null.
    """
    win, loss = F.col("profit") > 0, F.col("profit") <= 0
    n, wins = F.count(F.lit(1)), F.count_if(win)
    total_loss = F.sum(F.when(loss, -F.col("profit")).otherwise(0.0)) + charge * n
    total_profit = F.sum(F.when(win, F.col("profit")).otherwise(0.0))
    factor, ratio = F.try_divide(total_profit, total_loss), F.try_divide(F.avg(F.when(win, F.col("profit"))), F.avg(F.when(loss, -F.col("profit"))))
    return df.groupBy("symbol").agg(
        n.alias("trades"), wins.alias("wins"), F.count_if(loss).alias("losses"), ((F.lit(initial) + F.sum("profit")) / initial).alias("total_return"),
        total_profit.alias("total_profit"), total_loss.alias("total_loss"), factor.alias("profit_factor"),
        F.avg(F.when(win, F.col("profit"))).alias("avg_win"), F.avg(F.when(loss, -F.col("profit"))).alias("avg_loss"),
        F.count_if(win & F.col("stopped")).alias("stopped_gains"), F.count_if(loss & F.col("stopped")).alias("stopped_losses"), F.count_if(loss & ~F.col("stopped")).alias("unstopped_losses"),
        F.max(F.try_divide(-F.col("profit"), F.col("value_before"))).alias("max_pct_loss"), (wins / n).alias("win_fraction"), ratio.alias("avg_win_loss_ratio"),
        (factor * (wins / n) * ratio).alias("cpc"),
    )


def report_text(report: DataFrame) -> DataFrame:
    """(symbol, report): a line of counts, then a line a figure; a figure that there is none of is left empty."""
    counts = F.format_string("%s: %d trades, %d won, %d lost, %d gains stopped, %d losses stopped, %d not", "symbol", "trades", "wins", "losses", "stopped_gains", "stopped_losses", "unstopped_losses")
    figure = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.format_string("%.8f", c), F.lit("")))
    named = {"Return": "total_return", "Total profit": "total_profit", "Total loss": "total_loss", "Profit factor": "profit_factor", "Average win": "avg_win", "Average loss": "avg_loss", "Win fraction": "win_fraction", "Win/loss ratio": "avg_win_loss_ratio", "Largest loss": "max_pct_loss", "CPC index": "cpc"}
    return report.select("symbol", F.concat_ws("\n", counts, *[figure(*x) for x in named.items()]).alias("report"))


def fall(top: Column, low: Column) -> Column:
    return F.try_divide(top - low, top)


def joined(a: Column, b: Column) -> Column:
    """The drawdowns of two stretches of a series that follow each other: closes, head_low, worst, tail_top, tail_low.

    closes: whether a row reaches the peak before the stretch; head_low: the lowest value until then; worst: the largest fall
    that began and recovered inside; tail_top, tail_low: the last peak and the lowest value since. The operation is associative.
    """
    low = F.least(a["tail_low"], b["head_low"])
    recovered = F.when(b["closes"], fall(a["tail_top"], low))
    return F.struct(
        (a["closes"] | b["closes"]).alias("closes"), F.when(a["closes"], a["head_low"]).otherwise(F.least(a["head_low"], b["head_low"])).alias("head_low"),
        F.when(a["closes"], F.greatest(a["worst"], b["worst"], recovered)).otherwise(b["worst"]).alias("worst"),
        F.when(b["closes"], b["tail_top"]).otherwise(a["tail_top"]).alias("tail_top"), F.when(b["closes"], b["tail_low"]).when(a["closes"], low).alias("tail_low"),
    )


def max_drawdown(df: DataFrame, v: str, include_open: bool = False, unit: str = "month") -> DataFrame:
    """(symbol, max_drawdown): worst (peak - trough) / peak of drawdowns that recovered, or of all (include_open).

    A block of time (unit) is summed up in one row, given the peak before it; the rows of a year, then years, are joined.
    """
    rows = df.select("symbol", "ts", F.col(v).cast("double").alias("_v"), F.date_trunc(unit, "ts").alias("_block"))
    rows = W.with_folds(rows, F.col("_block"), _top=("max", F.col("_v")))
    block = Window.partitionBy("symbol", "_block")
    so_far = block.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_peak", F.sum(F.when(F.col("_v") == F.col("_top"), 1).otherwise(0)).over(so_far))  # each new or equal high begins one; 0: none yet
    parts = rows.groupBy("symbol", "_block", "_peak").agg(F.max("_top").alias("top"), F.min("_v").alias("low")).withColumn("_last", F.max("_peak").over(block))
    inside, tail = (F.col("_peak") > 0) & (F.col("_peak") < F.col("_last")), (F.col("_peak") > 0) & (F.col("_peak") == F.col("_last"))
    own = {
        "closes": F.max("_peak") > 0, "head_low": F.min(F.when(F.col("_peak") == 0, F.col("low"))), "worst": F.max(F.when(inside, fall(F.col("top"), F.col("low")))),
        "tail_top": F.max(F.when(tail, F.col("top"))), "tail_low": F.max(F.when(tail, F.col("low"))),
    }
    blocks = parts.groupBy("symbol", "_block").agg(F.struct(*[c.alias(n) for n, c in own.items()]).alias("s"))
    none = F.struct(F.lit(False).alias("closes"), *[F.lit(None).cast("double").alias(n) for n in own if n != "closes"])
    for keys in (["symbol", F.date_trunc("year", "_block").alias("_block")], ["symbol"]):
        line = F.array_sort(F.collect_list(F.struct("_block", "s")))
        blocks = blocks.groupBy(*keys).agg(F.aggregate(F.transform(line, lambda x: x["s"]), none, joined).alias("s"))
    open_ = F.when(F.lit(include_open), fall(F.col("s.tail_top"), F.col("s.tail_low")))
    return blocks.select("symbol", F.coalesce(F.greatest("s.worst", open_), F.lit(0.0)).alias("max_drawdown"))


def max_losses(df: DataFrame, p: int = 10) -> DataFrame:
    """(symbol, max_losses): most losses in p trades (with pos), from the compat average of 0 and p flags."""
    flagged = series.with_heads(df.withColumn("_flag", F.when(F.col("profit") > 0, 0.0).otherwise(float(p))), ["_flag"], p)
    rows = halo(flagged, p, ROWS, lambda d: series.sma(d, "_flag", p, "_avg", "compat"))
    return rows.groupBy("symbol").agg(F.max(F.floor(F.col("_avg") + 1e-9)).cast("int").alias("max_losses"))


def signal_accuracy(df: DataFrame, signal: str, out: str) -> DataFrame:
    """0 where there is no signal, 1 where its sign fits the bar's colour, else -1."""
    return df.withColumn(out, F.when(F.col(signal) == 0, 0).when(S.is_green() == (F.col(signal) > 0), 1).otherwise(-1))


def accuracy_pct(df: DataFrame, x: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(F.col(x) != 0).alias("n"), F.try_divide(F.count_if(F.col(x) == 1), F.count_if(F.col(x) != 0)).alias("accuracy"))


def signal_quality(df: DataFrame, hit: str, guess: float = 0.57) -> DataFrame:
    """(symbol, accuracy, confidence, overall) of hits 1, misses -1 and abstentions 0; what is abstained from counts as a guess."""
    found = accuracy_pct(df, hit, "symbol")
    total = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_all"))
    rows = found.join(total, "symbol").withColumn("confidence", F.col("n") / F.col("_all"))
    overall = F.col("accuracy") * F.col("confidence") + guess * (1 - F.col("confidence"))
    return rows.select("symbol", "accuracy", "confidence", overall.alias("overall"))


def compounded_return(df: DataFrame, side: str) -> DataFrame:
    """(symbol, total, won_pct): product of close/open for longs and open/close for shorts, and the share above 1."""
    step = F.when(F.col(side) > 0, F.try_divide(F.col("close"), F.col("open"))).otherwise(F.try_divide(F.col("open"), F.col("close")))
    rows = df.withColumn("_step", step)
    return rows.groupBy("symbol").agg(F.product("_step").alias("total"), (F.avg(F.when(F.col("_step") > 1, 1.0).otherwise(0.0)) * 100).alias("won_pct"))


def signal_backtest(df: DataFrame, prediction: str, margin: float = 1.0) -> DataFrame:
    """(symbol, total, hit_rate, n): each prediction held from its close to the next, fractional shares, compounding.

    A prediction of 0 counts as short.
    """
    change = F.try_divide(F.lead("close", 1).over(W.line()) - F.col("close"), F.col("close"))
    rows = halo(df, 0, ROWS, lambda d: d.withColumn("_r", change), 1).where("_r is not null").withColumn("_side", F.when(F.col(prediction) > 0, 1.0).otherwise(-1.0))
    return rows.groupBy("symbol").agg(F.product(1 + margin * F.col("_r") * F.col("_side")).alias("total"), F.avg(F.when(F.col("_r") * F.col("_side") > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.count(F.lit(1)).alias("n"))


def whole_share_backtest(df: DataFrame, prediction: str, initial: float, margin: float = 1.0, cost: float = 0.0) -> DataFrame:
    """(symbol, ts, shares, value): as signal_backtest with whole shares, whose number depends on the value so far.

    One fold a symbol; a symbol's rows stream through in Arrow batches and only the running value is held.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, value, old = None, initial, None
        for batch in batches:
            out = []
            for s, ts, close, p in zip(batch["symbol"], batch["ts"], batch["close"], batch["p"], strict=True):
                if s != symbol:
                    symbol, value, old = s, initial, None
                shares = 0
                if old is not None:
                    price, side = old
                    shares = max(0, int((value - cost) * margin // price)) if price > 0 else 0
                    value += side * shares * (close - price) - (2 * cost if shares else 0)
                    shares *= side
                out.append((s, ts, shares, value))
                old = (close, 1 if p > 0 else -1)
            yield pd.DataFrame(out, columns=["symbol", "ts", "shares", "value"])

    rows = df.select("symbol", "ts", "close", F.col(prediction).cast("double").alias("p")).repartition("symbol").sortWithinPartitions("symbol", "ts")
    return rows.mapInPandas(fold, "symbol string, ts timestamp_ntz, shares bigint, value double")


LEDGER = "account string, symbol string, seq bigint, action string, shares bigint, price double, position bigint, avg_cost double, realised double, equity double, invested double, buying_power double, error string"
LEDGER_ORDER = ["account", "symbol", "seq", "action", "shares", "price"]
LEDGER_STATE = {"position": "int64", "avg_cost": "float64", "realised": "float64", "equity": "float64", "invested": "float64", "buying_power": "float64", "error": "object"}


class Ledger:
    """Positions of one account: average cost, realised profit, equity, invested money and buying power."""

    def __init__(self, initial: float, margin: float, cost: float, positions: dict[str, tuple[int, float]] | None = None):
        self.equity, self.margin, self.cost, self.positions, self.invested = initial, margin, cost, {}, 0.0
        for symbol, own in (positions or {}).items():
            self.hold(symbol, *own)

    def hold(self, symbol: str, shares: int, average: float) -> None:
        self.positions[symbol] = (shares, average)
        self.invested = sum([abs(n) * c for n, c in self.positions.values()])

    @property
    def power(self) -> float:
        return self.equity * self.margin - self.invested

    def act(self, symbol: str, action: str, shares: int, price: float) -> tuple[float, str | None]:
        """Apply an order: (realised profit, null or why it was rejected)."""
        held, average = self.positions.get(symbol, (0, 0.0))
        sign = 1 if action in ("buy", "sell") else -1
        if action not in ("buy", "sell", "short", "cover") or shares <= 0:
            return 0.0, "Unknown order"
        if held * sign < 0:
            return 0.0, "Opposite position is open"
        if action in ("buy", "short"):
            if shares * price > (self.equity - self.cost) * self.margin - self.invested:
                return 0.0, "Insufficient buying power"
            self.hold(symbol, held + sign * shares, (abs(held) * average + shares * price) / (abs(held) + shares))
            self.equity -= self.cost
            return 0.0, None
        if shares > abs(held):
            return 0.0, "More than the position"
        profit = sign * shares * (price - average)
        left = held - sign * shares
        self.hold(symbol, left, average if left else 0.0)
        self.equity += profit - self.cost
        return profit, None


def ledger_rows(orders: pd.DataFrame, turn: Callable[[str], Ledger], account: str | None = None, ledger: Ledger | None = None) -> tuple[pd.DataFrame, str | None, Ledger | None]:
    """Orders that lie by account with the state after each, and the last account with its ledger, which the next may go on with.

    turn: gives the ledger of an account whose orders begin.
    """
    out, values = [], [orders[c].tolist() for c in ("account", "symbol", "action", "shares", "price")]
    for own, symbol, action, shares, price in zip(*values, strict=True):
        if ledger is None or own != account:
            account, ledger = own, turn(own)
        profit, error = ledger.act(symbol, action, int(shares), float(price))
        out.append((*ledger.positions.get(symbol, (0, 0.0)), profit, ledger.equity, ledger.invested, ledger.power, error))
    columns = zip(*out, strict=True) if out else [()] * len(LEDGER_STATE)
    return orders[LEDGER_ORDER].assign(**{n: np.array(v, kind) for (n, kind), v in zip(LEDGER_STATE.items(), columns, strict=True)}), account, ledger


def position_ledger(orders: DataFrame, initial: float, margin: float, cost: float) -> DataFrame:
    """The state of each account after each order (account, symbol, seq, action, shares, price); rejected ones have an error.

    Accounts are independent; the orders of one stream through in order of seq and only its positions are held.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, ledger = None, None
        for batch in batches:
            rows, account, ledger = ledger_rows(batch, lambda _: Ledger(initial, margin, cost), account, ledger)
            yield rows

    rows = orders.select(*LEDGER_ORDER).repartition("account").sortWithinPartitions("account", "seq")
    return rows.mapInPandas(fold, LEDGER)


def lookup_bar(log: DataFrame, bars: DataFrame) -> DataFrame:
    """Trade-log rows (ts, gain, shares, profit) with the bar of the same date; unmatched ones go."""
    return log.join(bars.select("symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close"), "ts")


def discretionary_trades(log: DataFrame, bars: DataFrame, initial: float, force_open: bool = True) -> DataFrame:
    """Trades reconstructed from a log: long where gain and green agree, entry at the open (or the exit less the gain).

    A losing trade is taken as stopped where the bar reaches entry - gain per share. Adds value_before and value_after.
    """
    return discretionary_of(lookup_bar(log, bars), initial, force_open)


def discretionary_of(rows: DataFrame, initial: float, force_open: bool = True) -> DataFrame:
    """As discretionary_trades, of log rows that already have their bars."""
    long = (F.col("gain") > 0) == S.is_green()
    side = F.when(long, "long").otherwise("short")
    exit_ = F.when(F.col("gain") > 0, F.col("close")).otherwise(F.when(long, F.greatest("low", F.col("open") + F.col("gain"))).otherwise(F.least("high", F.col("open") - F.col("gain"))))
    entry = F.col("open") if force_open else F.when(long, F.col("exit") - F.col("gain")).otherwise(F.col("exit") + F.col("gain"))
    rows = rows.withColumn("side", side).withColumn("exit", exit_).withColumn("entry", entry).withColumn("size", F.coalesce("shares", F.lit(100)))
    rows = rows.withColumn("stopped", (F.col("gain") <= 0) & (F.col("exit") != F.col("close")))
    return equity_curve(trade_pnl(rows), initial)


def discretionary_sized(rows: DataFrame, initial: float, margin: float, gains: bool = True, losses: bool = True, fix_slippage: bool = False, price: float | None = None) -> DataFrame:
    """Trades of log rows with their bars (symbol, ts, gain, open, high, low, close), sized by the account's value so far.

    A gain goes with the bar's colour and leaves at the open plus the gain, or at the close (fix_slippage); a loss goes
    against it and leaves at its stop, the open less the loss. Gains or losses that are left out, and a gain of null, are
    recorded flat at the open. A trade has value // open shares (or // price), each times margin; the whole number depends on
    the value, so that one fold a symbol streams through its rows and holds that value only. size is a double, which holds
    every whole number that a quotient of doubles is cut to; accounts that compound outgrow a bigint.
    """
    won, green = F.col("gain") >= 0, S.is_green()
    taken = F.coalesce(F.when(won, F.lit(gains)).otherwise((F.col("gain") < 0) & F.lit(losses)), F.lit(False))
    up = F.when(taken, F.when(won, green).otherwise(~green)).otherwise(F.lit(True))
    moved = F.when(up, F.col("open") + F.col("gain")).otherwise(F.col("open") - F.col("gain"))
    exit_ = F.when(~taken, F.col("open")).when(won & F.lit(fix_slippage), F.col("close")).otherwise(F.when(won & ~green, F.col("open") - F.col("gain")).otherwise(moved))
    rows = rows.withColumn("side", F.when(up, "long").otherwise("short")).withColumn("entry", F.col("open")).withColumn("exit", exit_)
    stop = F.when(~taken, F.col("open")).when(won, F.when(green, F.col("low") - 0.1).otherwise(F.col("high") + 0.1)).otherwise(F.col("exit"))
    rows = rows.withColumn("stop", stop).withColumn("unstopped_exit", F.col("close"))
    each = F.when(up, F.col("exit") - F.col("entry")).otherwise(F.col("entry") - F.col("exit")) * margin
    columns = ["symbol", "ts", "side", "entry", "stop", "exit", "unstopped_exit"]
    dealt = rows.select(*columns, each.alias("each"), (F.lit(price) if price else F.col("open")).alias("price")).repartition("symbol").sortWithinPartitions("symbol", "ts")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, value = None, initial
        for batch in batches:
            sizes, before, after = [], [], []
            for s, gain, cost in zip(batch["symbol"], batch["each"], batch["price"], strict=True):
                if s != symbol:
                    symbol, value = s, initial
                size = value / cost if cost else 0.0
                sizes.append(float(int(size)) if math.isfinite(size) else size)
                before.append(value)
                value += gain * sizes[-1]
                after.append(value)
            yield batch[columns].assign(size=sizes, profit=[b - a for a, b in zip(before, after, strict=True)], value_before=before, value_after=after)

    return dealt.mapInPandas(fold, "symbol string, ts timestamp_ntz, side string, entry double, stop double, exit double, unstopped_exit double, size double, profit double, value_before double, value_after double")


def trades_on_calendar(bars: DataFrame, trades: DataFrame, unstopped: bool = False) -> DataFrame:
    """Every bar date between a symbol's first and last trade; dates without one carry the last trade's value on.

    trades: (symbol, ts, entry, exit, value_after). Adds is_fill; filled rows have entry = exit = the last exit, or (unstopped)
    the last trade's unstopped_exit.
    """
    ends = trades.groupBy("symbol").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    days = bars.select("symbol", "ts").join(ends, "symbol").where("ts between _a and _b").drop("_a", "_b")
    left = F.col("unstopped_exit") if unstopped else F.col("exit")
    rows = days.join(trades.select("symbol", "ts", F.struct("entry", "exit", "value_after", left.alias("left")).alias("t")), ["symbol", "ts"], "left")
    rows = W.with_folds(rows.withColumn("is_fill", F.col("t").isNull()), t=("last", F.col("t")))
    kept = lambda c: F.when(F.col("is_fill"), F.col("t.left")).otherwise(F.col(f"t.{c}")).alias(c)
    return rows.select("symbol", "ts", kept("entry"), kept("exit"), F.col("t.value_after").alias("value_after"), "is_fill")


def risk_sizing(df: DataFrame, ema_out: str, atr_out: str) -> DataFrame:
    """Adds size and stop from risk a share = 1.2 (0.65 average wick + 0.35 average range), 2.5 % of the account at risk."""
    risk = 1.2 * (0.65 * F.col(ema_out) + 0.35 * F.col(atr_out))
    rows = df.withColumn("risk", risk).withColumn("size_pct", F.try_divide(F.lit(0.025), F.col("risk")))
    return rows.withColumn("stop", F.when(F.col("side") == "long", F.col("open") - F.col("risk")).otherwise(F.col("open") + F.col("risk")))
