"""Building blocks of the SQL that mirrors the registered queries (DuckDB dialect)."""

from __future__ import annotations


def bars(table: str, symbol: str, ts: str, unit: str, price: str, tie: str) -> str:
    return f"""bars as (select {symbol} as symbol, date_trunc('{unit}', {ts})::timestamp as ts, arg_min({price}::double, ({ts}, {tie})) as open,
        max({price}::double) as high, min({price}::double) as low, arg_max({price}::double, ({ts}, {tie})) as close, count(*)::bigint as volume
        from {table} group by 1, 2)"""


EVENTS = bars("events", "event_type", "ts", "hour", "value", "event_id")
ORDERS = bars("orders", "o_orderpriority", "o_orderdate", "day", "o_totalprice", "o_orderkey")
POS = "p as (select *, row_number() over (partition by symbol order by ts) - 1 as pos from bars)"
LINE = "partition by symbol order by ts"


def windows(p: int) -> str:
    return f"""window w as ({LINE}), cum as ({LINE} rows unbounded preceding), wp as ({LINE} rows between {p - 1} preceding and current row),
        wb as ({LINE} rows between {p} preceding and 1 preceding), s as (partition by symbol)"""


def series(value: str, p: int = 10, pre: str = "", source: str = "p", where: str = "true", base: str = EVENTS) -> str:
    """(symbol, ts, value) of an expression over windows of p rows; pre: further CTEs, each starting with a comma."""
    return f"with {base}, {POS}{pre}, v as (select symbol, ts, pos, ({value})::double as value from {source} {windows(p)}) select symbol, ts, round(value, 6) + 0.0 as value from v where {where}"


def recursive(begin: str, step: str, pre: str = "", source: str = "p", value: str = "v", p: int = 10, base: str = EVENTS) -> str:
    """(symbol, ts, value) of a recurrence: begin in the first row, then step of b (this row) and r.v (the last value)."""
    return f"""with recursive {base}, {POS}{pre}, b as (select * from {source}),
        r as (select symbol, pos, ts, ({begin})::double as v from b where pos = 0
              union all select b.symbol, b.pos, b.ts, ({step})::double from r join b on b.symbol = r.symbol and b.pos = r.pos + 1),
        o as (select *, {value} as value from r {windows(p)})
        select symbol, ts, round(value, 6) + 0.0 as value from o"""


#: Trades: the sign of the last bar's momentum held for a session, 100 shares, the last bar's opening wick as stop.
TRADES = f"""{ORDERS}, {POS},
    t0 as (select *, close - coalesce(lag(close, 10) over w, first_value(close) over w) as m, case when close >= open then open - low else high - open end as wick from p window w as ({LINE})),
    t1 as (select *, case when lag(m) over w >= 0 then 'long' else 'short' end as side, lag(wick) over w as pw from t0 window w as ({LINE})),
    t2 as (select symbol, ts, pos, open, high, low, close, side, 100 as size, case when side = 'long' then open - pw else open + pw end as stop from t1 where pos >= 1),
    t3 as (select *, open as entry, close as unstopped_exit, coalesce(case when side = 'long' then low <= stop else high >= stop end, false) as stopped from t2),
    t4 as (select *, case when stopped then stop else close end as exit from t3),
    t5 as (select *, (case when side = 'long' then 1 else -1 end) * size * (exit - entry) - 2 * 4.95 as profit from t4),
    t6 as (select *, 1e9 + sum(profit) over ({LINE} rows unbounded preceding) as value_after from t5),
    t as (select *, value_after - profit as value_before from t6)"""
