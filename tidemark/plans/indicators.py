"""Registered queries: projections, windows and recurrences over bars, each with the SQL that mirrors it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import frames as W
from tidemark.functions import scalar as S
from tidemark.operators import recursive as R
from tidemark.operators import series as O
from tidemark.operators.halo import ROWS, halo
from tidemark.plans import sql
from tidemark.sources.bars import bars_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def tidy(x: str | Column, digits: int = 6) -> Column:
    return F.round(S.col(x), digits) + 0.0


def in_buckets(df: DataFrame, operator: Callable[[DataFrame], DataFrame], reach: int | None, ahead: int = 0) -> DataFrame:
    """operator(df), in buckets of the series if it looks back `reach` rows at most."""
    return operator(df) if reach is None else halo(df, reach, ROWS, operator, ahead)


def indicator(name: str, operator: Callable[[DataFrame], DataFrame], text: str | None, reach: int | None = None, ahead: int = 0) -> None:
    """Register operator(bars with pos), which adds `value` and looks back `reach` rows (None: it sees to that), as (symbol, ts, value)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = in_buckets(W.with_pos(bars_events(spark, sf_dir)), operator, reach, ahead)
        return df.select("symbol", "ts", tidy("value").alias("value"))

    QUERIES[name] = run
    if text:
        SQL[name] = text


def column(name: str, value: Callable[[], Column], text: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bars_events(spark, sf_dir).select("symbol", "ts", tidy(value().cast("double")).alias("value"))

    QUERIES[name], SQL[name] = run, sql.series(text)


V = "value"
GREEN = "case when close >= open then 1 else -1 end"
column("closes", lambda: F.col("close"), "close")
column("opens", lambda: F.col("open"), "open")
column("weighted_price", lambda: S.weighted_price(1, 2, 3, 4), "(open + low * 2 + high * 3 + close * 4) / 10")
column("range_midpoint", lambda: S.midpoint(), "(low + high) / 2")
column("opening_wick", lambda: S.opening_wick(), "case when close >= open then open - low else high - open end")
column("constant_line", lambda: F.lit(2.5), "2.5")
column("sign_series", lambda: F.signum(F.col("close") - F.col("open")), "sign(close - open)")
column("to_simple_signal", lambda: S.simple_signal(S.bias(F.col("close") - F.col("open"))), "case when close - open >= 0 then 1 else -1 end")
column("pct_open_close", lambda: S.pct_of("open", "close"), "(open - close) / nullif(open, 0) * 100")
column("pct_high_low", lambda: F.try_divide(F.col("high") - F.col("low"), F.col("low")) * 100, "(high - low) / nullif(low, 0) * 100")
column("average_two", lambda: (F.col("open") + F.col("close")) / 2, "(open + close) / 2")
column("quantize", lambda: S.quantize("close", 1.0, 0.25), "round_even((close - 1) / 0.25, 0) * 0.25 + 1")
column("clamp", lambda: S.clamp("close", 20.0, 60.0), "least(60.0, greatest(20.0, close))")
column("clip", lambda: S.clamp("close", F.col("open") * 0.9, F.col("open") * 1.1), "least(open * 1.1::double, greatest(open * 0.9::double, close))")
column("between", lambda: F.when(F.col("close").between(20.0, 60.0), 1.0).otherwise(0.0), "case when close between 20 and 60 then 1.0 else 0.0 end")
column("gene_cast", lambda: S.whole(F.col("close") / 2), "round_even(close / 2, 0)")
column("gaussian", lambda: S.gaussian(50.0, "close"), "exp(-pow(close / 50, 2))")
column("logistic", lambda: S.logistic(F.col("close") / 50), "1 / (1 + exp(-close / 50))")
indicator("sma", lambda d: O.sma(d, "close", 10, V), sql.series("avg(close) over wp"), reach=9)
indicator(
    "sma_compat", lambda d: halo(O.with_heads(d, ["close"], 10), 10, ROWS, lambda e: O.sma(e, "close", 10, V, "compat")),
    sql.recursive("close", "case when b.pos < 10 then (r.v * (b.pos + 1) + b.close) / (b.pos + 2) else r.v + (b.close - b.old) / 10 end", ", q as (select *, lag(close, 10) over w as old from p window w as (partition by symbol order by ts))", "q"),
)
indicator("momentum", lambda d: O.momentum(d, "close", 10, V), sql.series("close - coalesce(lag(close, 10) over w, first_value(close) over w)"), reach=10)
indicator("trend", lambda d: O.trend(d, 5, V), sql.series(f"case when pos < 5 then 0.0 else sign(sum({GREEN}) over wb) end", 5), reach=5)
indicator("donchian_min", lambda d: O.donchian_min(d, 10, V, 0.1), sql.series("(min(low) over wp + max(high) over wp) / 2 - (max(high) over wp - min(low) over wp) / 2 * 1.1"), reach=9)
indicator("donchian_max", lambda d: O.donchian_max(d, 10, V, 0.1), sql.series("(min(low) over wp + max(high) over wp) / 2 + (max(high) over wp - min(low) over wp) / 2 * 1.1"), reach=9)
indicator("donchian_avg", lambda d: O.donchian_avg(d, 10, V), sql.series("(min(low) over wp + max(high) over wp) / 2"), reach=9)
indicator("donchian_pct", lambda d: O.donchian_pct(d, 10, "close", V), sql.series("(close - min(low) over wp) / nullif(max(high) over wp - min(low) over wp, 0)"), reach=9)
FLIP = f", q as (select *, case when ({GREEN}) <> lag({GREEN}) over (partition by symbol order by ts) then 1.0 else 0.0 end as flip from p)"
indicator(
    "reversal_volatility", lambda d: O.reversal_volatility(d, 5, V),
    sql.series("case when pos < 4 then 0.0 else " + " + ".join(f"coalesce(lag(flip, {i - 1}) over w, 0) * {((5 - i) / 5) ** 2}" for i in range(1, 5)) + " end", 5, FLIP, "q"),
    reach=5,
)
indicator(
    "reversals2", lambda d: O.reversals2(d, 5, 0.5, V),
    sql.series("case when pos < 5 then 0.0 else greatest(0.0, " + " + ".join(f"(lag(flip, {i}) over w * {(5 - i) / 5} - (1 - lag(flip, {i}) over w) * {(5 - i) / 10})" for i in range(5)) + ") end", 5, FLIP, "q"),
    reach=6,
)
indicator("bar_sum1", lambda d: O.bar_sum1(d, 10, V), sql.series("sum(close - open) over wp / 10"), reach=9)


def weighted(x: str, p: int, power: int, over: str) -> str:
    """Sum of ((n - i) ^ power) * x over the last n rows from lags, divided by `over`."""
    parts = " + ".join(f"pow(least(pos + 1, {p}) - {i}, {power}) * case when pos >= {i} then lag({x}, {i}) over w else 0 end" for i in range(p))
    return f"({parts}) / ({over})"


indicator("bar_sum2", lambda d: O.bar_sum2(d, 5, V), sql.series(weighted("close - open", 5, 1, "pow(least(pos + 1, 5), 2)"), 5), reach=4)
indicator(
    "bar_sum3", lambda d: O.bar_sum3(d, 5, 10, 3, V),
    sql.series(
        weighted("x", 3, 1, "pow(least(pos + 1, 3), 2)"), 10,
        f", q0 as (select *, {weighted('close - open', 5, 1, 'pow(least(pos + 1, 5), 2)')} as s, max(abs(close - open)) over wp as m from p {sql.windows(10)}), q as (select *, coalesce(s * 10 / nullif(m, 0), 0) as x from q0)", "q",
    ),
    reach=13,
)
indicator("triangular_ma", lambda d: O.triangular_ma(d, "close", 5, V), sql.series(weighted("close", 5, 1, "pow(least(pos + 1, 5), 2)"), 5), reach=4)
indicator("parabolic_ma", lambda d: O.parabolic_ma(d, "close", 5, V), sql.series(weighted("close", 5, 2, "pow(least(pos + 1, 5), 2) * 5"), 5), reach=4)
indicator("common_color", lambda d: O.common_color(d, 4, V), sql.series(f"case when sum({GREEN}) over wp <> 0 then sign(sum({GREEN}) over wp) else {GREEN} end::double", 4), reach=3)
indicator("lin_reg", lambda d: O.lin_reg(d, "close", 10, 1, V), sql.series("case when pos = 0 then close else avg(close) over wp + regr_slope(close, pos) over wp * (pos + 1 - avg(pos) over wp) end"), reach=9)
indicator("lin_reg_slope", lambda d: O.lin_reg_slope(d, "close", 4, V), sql.series("case when pos = 0 then close else regr_slope(close, pos) over wp end", 4), reach=3)
indicator("r_squared", lambda d: O.r_squared(d, "close", 10, V), sql.series("case when pos < 9 or max(close) over wp = min(close) over wp then 0 else coalesce(regr_r2(close, pos) over wp, 0) end"), reach=9)
indicator("fosc", lambda d: O.fosc(d, "close", 10, V), sql.series("100 * (close - case when pos = 0 then close else avg(close) over wp + regr_slope(close, pos) over wp * (pos - avg(pos) over wp) end) / nullif(close, 0)"), reach=9)
indicator("derivative", lambda d: O.derivative(d, "close", V), sql.series("coalesce(close - lag(close) over w, 0)"), reach=1)
indicator("integral", lambda d: O.integral(d, "close", 3.0, V), sql.series("3 + sum(close) over cum"))
indicator("percent_return", lambda d: O.percent_return(d, "close", V), sql.series("case when pos = 0 then 0 else (close - lag(close) over w) / nullif(lag(close) over w, 0) end"), reach=1)
indicator("roc_close", lambda d: O.percent_return(d, "close", V, 100.0), sql.series("case when pos = 0 then 0 else (close - lag(close) over w) / nullif(lag(close) over w, 0) * 100 end"), reach=1)
indicator("extrapolate", lambda d: O.extrapolate(d, "close", V), sql.series("case when pos < 2 then first_value(close) over w else 2 * lag(close, 1) over w - lag(close, 2) over w end"), reach=2)
indicator("normalize_sma10", lambda d: O.normalize_sma(d, "close", 10, V, "textbook"), sql.series("coalesce(100 * (close - avg(close) over wp) / nullif(avg(close) over wp, 0), 0)"), reach=9)
indicator("normalize_unit", lambda d: O.normalize_unit(d, "close", V), sql.series("(close - min(close) over s) / nullif(max(close) over s - min(close) over s, 0)"))
indicator("scale_to_range", lambda d: O.normalize_unit(d, "close", "u").withColumn(V, F.col("u") * 100 - 50), sql.series("(close - min(close) over s) / nullif(max(close) over s - min(close) over s, 0) * 100 - 50"))
indicator("next_close_label", lambda d: O.next_close_label(d, V), sql.series("case when lead(close) over w - close >= 0 then 1 when lead(close) over w - close < 0 then -1 end::double"), reach=0, ahead=1)
indicator("null_signal", lambda d: d.withColumn(V, F.lit(0.0)), sql.series("0.0"), reach=0)
indicator("running_mean_online", lambda d: O.sma(d, "close", 7, V), sql.series("avg(close) over wp", 7), reach=6)
indicator("running_std_online", lambda d: O.running_std(d, "close", 7, V), sql.series("stddev_pop(close) over wp", 7), reach=6)
indicator("stddev_pop", lambda d: W.with_totals(d, value=F.stddev_pop("close")), sql.series("stddev_pop(close) over s"))
indicator("delay", lambda d: O.delay(d.withColumn(V, F.col("close")), [V], 3), sql.series("lag(close, 3) over w", where="pos >= 3"), reach=3)
indicator("udf_signal", lambda d: SIGNALS["close_direction"](d, V), sql.series("case when pos = 0 then 0 when close - lag(close) over w >= 0 then 1 else -1 end::double"), reach=1)
#: Label functions by name.
SIGNALS = {"close_direction": O.close_direction, "null": lambda d, out: d.withColumn(out, F.lit(0))}


def ema_sql(x: str, p: float, pre: str = "", source: str = "p", value: str = "v", window: int = 10) -> str:
    k = 2 / (1 + p)
    return sql.recursive(x, f"{k} * ({x.replace('close', 'b.close').replace('high', 'b.high').replace('low', 'b.low') if source == 'p' else 'b.' + x}) + {1 - k} * r.v", pre, source, value, window)


indicator("ema", lambda d: R.ema(d, "close", 10, V), ema_sql("close", 10))
indicator("ema_blocks", lambda d: R.ema(d, "close", 10, V, block=64), ema_sql("close", 10))
indicator("zlema", lambda d: R.zlema(d, "close", 10, V), sql.recursive("close", f"case when b.pos < 5 then b.close else {2 / 11} * (2 * b.close - b.old) + {9 / 11} * r.v end", f", q as (select *, lag(close, 5) over ({sql.LINE}) as old from p)", "q"))
TR = f", q as (select *, greatest(high - low, coalesce(abs(low - lag(close) over w), 0), coalesce(abs(high - lag(close) over w), 0)) as tr from p window w as ({sql.LINE}))"
indicator("atr", lambda d: R.atr(d, 7, V), sql.recursive("tr", "((least(b.pos + 1, 7) - 1) * r.v + b.tr) / least(b.pos + 1, 7)", TR, "q"))
indicator(
    "heiken_ashi", lambda d: R.heiken_ashi(d).withColumn(V, F.col("ha_open") + F.col("ha_high") * 2 + F.col("ha_low") * 3 + F.col("ha_close") * 5),
    f"""with recursive {sql.EVENTS}, {sql.POS},
        r as (select symbol, pos, ts, open as o, low as l, high as h, close as c from p where pos = 0
              union all select b.symbol, b.pos, b.ts, (r.o + r.c) / 2, least(b.low, (r.o + r.c) / 2), greatest(b.high, (r.o + r.c) / 2), (b.open + b.low + b.high + b.close) / 4
              from r join p b on b.symbol = r.symbol and b.pos = r.pos + 1)
        select symbol, ts, round(o + h * 2 + l * 3 + c * 5, 6) + 0.0 as value from r""",
)
indicator(
    "macd", lambda d: R.macd(d, "close", 10, 21, V),
    f"""with recursive {sql.EVENTS}, {sql.POS},
        r as (select symbol, pos, ts, close as f, close as s from p where pos = 0
              union all select b.symbol, b.pos, b.ts, {2 / 11} * b.close + {9 / 11} * r.f, {2 / 22} * b.close + {20 / 22} * r.s from r join p b on b.symbol = r.symbol and b.pos = r.pos + 1)
        select symbol, ts, round(f - s, 6) + 0.0 as value from r""",
)
indicator(
    "rsi", lambda d: R.rsi(d, "close", 10, V),
    f"""with recursive {sql.EVENTS}, {sql.POS}, q as (select *, coalesce(close - lag(close) over ({sql.LINE}), 0) as m from p),
        r as (select symbol, pos, ts, 0.0::double as u, 0.0::double as d from q where pos = 0
              union all select b.symbol, b.pos, b.ts, {2 / 11} * greatest(b.m, 0) + {9 / 11} * r.u, {2 / 11} * greatest(-b.m, 0) + {9 / 11} * r.d from r join q b on b.symbol = r.symbol and b.pos = r.pos + 1)
        select symbol, ts, round(case when pos = 0 then 50 when d = 0 and u > 0 then 100 else 100 - 100 / (1 + u / nullif(d, 0)) end, 6) + 0.0 as value from r""",
)
indicator("chaikin_volatility", lambda d: R.chaikin_volatility(d, 10, V), ema_sql("high - low", 10, value="100 * (v - coalesce(lag(v, 10) over w, first_value(v) over w)) / nullif(coalesce(lag(v, 10) over w, first_value(v) over w), 0)"))
indicator("reversal_index", lambda d: R.reversal_index(d, 10, V), ema_sql("same", 10, FLIP + ", q2 as (select *, case when pos = 0 then 0.0 else 1 - 2 * flip end as same from q)", "q2"))
indicator(
    "anti_trend_index", lambda d: R.anti_trend_index(d, 4, 10, V),
    ema_sql("fits", 10, f", q as (select *, case when (case when pos = 0 then close else regr_slope(close, pos) over wp end >= 0) = (close >= open) then 1.0 else -1.0 end as fits from p {sql.windows(4)})", "q"),
)
indicator(
    "wick_stops", lambda d: R.wick_stops(d, 10, 2, 3, V),
    ema_sql("kth", 4, f", q0 as (select *, case when close >= open then open - low else high - open end as wick from p), q as (select *, case when pos < 9 then 0.0 else list_reverse_sort(list(wick) over wp)[3] end as kth from q0 {sql.windows(10)})", "q"),
)


def swing_sql(s: int, x: str, sign: int, none: str, revise: bool = False) -> str:
    value = f"case when pos < {2 * s} then 0.0 when id = 0 then {none} when top <= level then {sign} * level end"
    if revise:
        value = f"coalesce({sign} * last_value(pv ignore nulls) over ({sql.LINE} rows between current row and {s} following), {value})"
    return f"""with {sql.EVENTS}, {sql.POS},
        a as (select *, {sign} * {x} as x from p),
        b as (select *, lag(x, {s}) over ({sql.LINE}) as mid, max(x) over ({sql.LINE} rows between {2 * s} preceding and {s + 1} preceding) as l,
              max(x) over ({sql.LINE} rows between {s - 1} preceding and current row) as rt from a),
        c as (select *, case when pos >= {2 * s} and mid > l and mid >= rt then mid end as pv from b),
        d as (select *, count(pv) over ({sql.LINE} rows unbounded preceding) as id from c),
        e as (select *, max(pv) over (partition by symbol, id) as level, max(x) over (partition by symbol, id order by ts rows unbounded preceding) as top from d)
        select symbol, ts, round({value}, 6) + 0.0 as value from e"""


indicator("swing", lambda d: O.swing(d, 3, "high", V), swing_sql(3, "high", 1, "null"))
indicator("swing_low", lambda d: O.swing(d, 3, "low", V, "low"), swing_sql(3, "low", -1, "0.0"))
indicator("swing_revised", lambda d: O.swing(d, 3, "high", V, revise=True), swing_sql(3, "high", 1, "null", True))


def lists(name: str, operator: Callable[[DataFrame], DataFrame], text: str, reach: int) -> None:
    """Register an operator whose value is an array, as its length and a position-weighted sum."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = in_buckets(W.with_pos(bars_events(spark, sf_dir)), operator, reach)
        total = F.aggregate(F.transform(V, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
        return df.select("symbol", "ts", F.size(V).cast("bigint").alias("n"), tidy(total).alias("weighted_sum"))

    QUERIES[name] = run
    SQL[name] = text


def list_sql(order: str, where: str = "true", value: str = "close", p: int = 4) -> str:
    return f"""with {sql.EVENTS}, {sql.POS}, v as (select symbol, ts, pos, {order} as l from p {sql.windows(p)})
        select symbol, ts, len(l)::bigint as n, round(list_sum(list_transform(l, lambda x, i: x * i)), 6) + 0.0 as weighted_sum from v where {where}"""


lists("back_bars", lambda d: O.back_bars(d, "close", 4, V), list_sql("list_reverse(list(close) over wp)"), 3)
lists("sliding_examples", lambda d: O.sliding_examples(d, "close", 4, V), list_sql("list(close) over wp", "pos >= 3"), 3)
lists(
    "ratio_inputs", lambda d: O.ratio_inputs(d).withColumn(V, F.concat("inputs", F.array(F.col("up").cast("double")))),
    list_sql("[open / o1, 1.0, lag(low) over w / o1, lag(high) over w / o1, lag(close) over w / o1, (close > open)::int::double]", "pos >= 1").replace("from p ", f"from (select *, lag(open) over ({sql.LINE}) as o1 from p) "),
    1,
)
