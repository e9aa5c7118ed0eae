"""Registered queries: sources, alignment, aggregates, trading, models, search, views; with SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import frames as W
from tidemark.functions import scalar as S
from tidemark.operators import align as A
from tidemark.operators import models as M
from tidemark.operators import recursive as R
from tidemark.operators import search as G
from tidemark.operators import series as O
from tidemark.operators import trading as T
from tidemark.operators import views as V
from tidemark.operators.halo import ROWS, halo, two_level_pos
from tidemark.plans import sql
from tidemark.plans.indicators import tidy
from tidemark.sources import barfiles, sinks
from tidemark.sources import bars as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
E, O_, P = sql.EVENTS, sql.ORDERS, sql.POS
FIVE = "'1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'"
OTHERS = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
INITIAL = 1e9
scratch = G.scratch


def query(text: str | None = None, name: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__.removesuffix("_")
        QUERIES[key] = f
        if text:
            SQL[key] = text
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.with_pos(B.bars_events(spark, sf_dir))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.with_pos(B.bars_orders(spark, sf_dir))


# --- the flagship: how often momentum calls the next hour's direction


def called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with their momentum m over ten rows and the label of the next one's direction."""
    return halo(events(spark, sf_dir), 10, ROWS, lambda d: O.next_close_label(O.momentum(d, "close", 10, "m"), "label"), 1)


@query(f"""with {E}, {P}, m as (select *, close - coalesce(lag(close, 10) over w, first_value(close) over w) as m, lead(close) over w - close as d from p window w as ({sql.LINE}))
    select symbol, count(*)::bigint as n, round(avg(case when (m > 0) = (d >= 0) then 1.0 else 0.0 end), 6) as accuracy from m where d is not null and m <> 0 group by 1""")
def momentum_calls(spark, sf_dir):
    df = called(spark, sf_dir).where("label is not null and m <> 0")
    hit = F.when(F.signum("m") == F.col("label"), 1.0).otherwise(0.0)
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))


# --- sources


def bars_sql(base: str) -> str:
    return f"with {base} select * from bars"


@query(bars_sql(E))
def bars_events(spark, sf_dir):
    return B.bars_events(spark, sf_dir)


@query(bars_sql(O_))
def bars_orders(spark, sf_dir):
    return B.bars_orders(spark, sf_dir)


@query(bars_sql(sql.bars("lineitem", "l_returnflag", "l_shipdate", "day", "l_extendedprice", "l_orderkey, l_linenumber, l_partkey, l_suppkey")))
def bars_lineitem(spark, sf_dir):
    return B.bars_lineitem(spark, sf_dir)


@query(f"with {O_} select symbol, ts, open, high, low, close, volume from bars")
def read_bars(spark, sf_dir):
    path = scratch(spark, "bars")
    B.write_bars(B.bars_orders(spark, sf_dir), path)
    return barfiles.read_bars(spark, path)


@query(f"with {O_} select symbol, strftime(ts, '%Y%m%d') || ';' || format('{{:.6f}};{{:.6f}};{{:.6f}};{{:.6f}};', open, high, low, close) || volume as line from bars")
def write_bars(spark, sf_dir):
    return B.bars_text(B.bars_orders(spark, sf_dir))


@query(f"with {E} select * from bars where symbol = 'click'")
def bars_by_symbol(spark, sf_dir):
    return B.bars_events(spark, sf_dir).where(F.col("symbol") == "click")


@query(f"with {O_} select * from bars where symbol in ('1-URGENT', '5-LOW') and ts between '1996-01-01' and '1997-12-31'")
def load_universe(spark, sf_dir):
    return B.universe(B.bars_orders(spark, sf_dir), ["1-URGENT", "5-LOW"], "1996-01-01", "1997-12-31")


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 200000 order by o_totalprice")
def scan_filter_sort(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_totalprice > 200000").orderBy("o_totalprice").select("o_orderkey", "o_totalprice")


@query("select c_custkey, c_name from customer where c_custkey = (select min(c_custkey) from customer)")
def get_exactly_one(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    least = customers.agg(F.min("c_custkey").alias("c_custkey"))
    return B.exactly_one(customers.join(F.broadcast(least), "c_custkey"), F.lit(True))


@query("select o_orderdate::timestamp as ts, round(o_totalprice, 2)::double as gain, (o_orderkey % 500)::bigint as shares, (o_orderkey / 4)::double as profit from orders")
def read_trade_log(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    line = F.concat_ws("  ", F.date_format("o_orderdate", "M/d/yyyy"), F.format_string("%.2f", "o_totalprice"), F.col("o_orderkey") % 500, F.col("o_orderkey") / 4)
    path = scratch(spark, "log")
    rows.select(line).write.text(path)
    return B.read_trade_log(spark.read.text(path))


def reports_of(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A report for every order of rows, written and read back."""
    text = F.format_string("=== BEST ===\nStrategy : S%d\nFitness : %.2f\nperiod: %d", F.col("o_orderkey") % 7, "o_totalprice", F.col("o_custkey") % 9)
    path = scratch(spark, "reports")
    rows.select(text).write.text(path)
    return B.read_search_reports(spark, path).select("strategy", "fitness", F.col("params")["period"].alias("period"))


@query("select 'S' || (o_orderkey % 7) as strategy, round(o_totalprice, 2)::double as fitness, (o_custkey % 9)::varchar as period from orders")
def read_search_reports(spark, sf_dir):
    return reports_of(spark, table(spark, sf_dir, "orders"))


@query(f"with {O_} select 'vendor' as symbol, ts, open, high, low, close, volume from bars where symbol = '5-LOW'")
def normalize_vendor_csv(spark, sf_dir):
    path = scratch(spark, "vendor")
    rows = B.bars_orders(spark, sf_dir).where("symbol = '5-LOW'").orderBy(F.col("ts").desc())
    rows.select(F.date_format("ts", "yyyy-MM-dd").alias("Date"), *[F.col(c).alias(c.title()) for c in A.FIELDS]).write.option("header", True).csv(path)
    return B.normalize_vendor_csv(spark, path, "vendor")


@query(f"with {O_} select symbol || ' ' || extract(year from ts) as page_id, ts, open, high, low, close, volume from bars where ts >= '1996-01-01'")
def extract_price_tables(spark, sf_dir):
    bars = B.bars_orders(spark, sf_dir)
    cells = F.concat(*[F.concat(F.lit('<td class="tabledata">'), c, F.lit("</td>")) for c in (F.date_format("ts", "MMM d, yyyy"), *[F.regexp_replace(F.col(x).cast("decimal(20,6)").cast("string"), r"(\d)(?=(\d{3})+\.)", "$1,") for x in ("open", "high", "low", "close")], F.col("volume").cast("string"), F.lit("0"))])
    pages = bars.groupBy(F.concat_ws(" ", "symbol", F.year("ts")).alias("page_id")).agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list(F.concat(F.lit("<tr>"), cells, F.lit("</tr>"))), ""), F.lit("</table>")).alias("html"))
    pages = pages.unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string"), "html"))  # which hold no such row
    return B.extract_price_tables(pages, "1996-01-01")


@query("""select page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::bigint as n_links, replace(regexp_extract_all(html, 'href="([^"]*)"', 1)[1], '&amp;', '&') as first_link,
    nullif(replace(regexp_extract(html, '(?is)<a\\b[^>]*href="([^"]*)"[^>]*>\\s*Next\\s*</a>', 1), '&amp;', '&'), '') as next_link from pages""")
def extract_next_link(spark, sf_dir):
    return B.page_links(table(spark, sf_dir, "pages"))


SENT_SQL = """select 'event' as origin, event_id as id, case when try_cast(json_extract_string(props, '$.k') as bigint) is not null then 'props' else 'unknown' end as route, try_cast(json_extract_string(props, '$.k') as bigint)::double as value from events
    union all select 'order', o_orderkey, 'order', round(o_totalprice, 2) from orders
    union all select 'customer', c_custkey, 'customer', len(c_mktsegment) from customer union all select 'nation', n_nationkey, 'unknown', null from nation"""


def messages(read: Callable[[str], DataFrame]) -> DataFrame:
    """(origin, id, text): messages of three types and one that no type is known for; read gives a table by its name."""
    sent = lambda name, origin, key, body: read(name).select(F.lit(origin).alias("origin"), F.col(key).cast("bigint").alias("id"), body.alias("text"))
    typed = lambda kind, **fields: F.to_json(F.struct(F.lit(kind).alias("Type"), *[c.alias(n) for n, c in fields.items()]))
    rows = sent("events", "event", "event_id", F.col("props"))
    rows = rows.unionByName(sent("orders", "order", "o_orderkey", typed("order", id=F.col("o_orderkey"), price=F.round("o_totalprice", 2))))
    rows = rows.unionByName(sent("customer", "customer", "c_custkey", typed("customer", id=F.col("c_custkey"), segment=F.col("c_mktsegment"))))
    return rows.unionByName(sent("nation", "nation", "n_nationkey", typed("nation", id=F.col("n_nationkey"))))


@query(SENT_SQL)
def decode_typed_json(spark, sf_dir):
    """What no type is known for becomes a dead letter."""
    out = B.decode_typed_json(messages(lambda name: table(spark, sf_dir, name)), "text", B.MESSAGES, default="props")
    return out.select("origin", "id", "route", F.coalesce(F.col("props.k").cast("double"), "order.price", F.length("customer.segment").cast("double")).alias("value"))


@query(f"with {O_} select symbol, ts, close from bars where ts >= (select max(ts) from bars where ts < '2000-01-01') + interval 1 day")
def incremental_load(spark, sf_dir):
    bars = B.bars_orders(spark, sf_dir).select("symbol", "ts", "close")
    return B.newer_than_stored(bars, bars.where("ts < '2000-01-01'"))


# --- sinks


@query(f"with {sql.TRADES} select symbol, side, round(entry, 2) as entry, round(exit, 2) as exit, round(profit, 2) as profit from t")
def write_trades_csv(spark, sf_dir):
    path = scratch(spark, "trades")
    sinks.write_trades_csv(trades(spark, sf_dir), path)
    rows = spark.read.option("header", True).schema("symbol string, side string, entry double, stop double, exit double, unstopped_exit double, entry_time timestamp, exit_time timestamp, size int, profit double, value_before double, value_after double").csv(path)
    return rows.select("symbol", "side", *[F.round(c, 2).alias(c) for c in ("entry", "exit", "profit")])


@query("select o_orderkey, o_custkey % 5 as run_id from orders")
def store_append(spark, sf_dir):
    """Two batches, both delivered twice, and a third whose write broke off before its manifest and was run again."""
    path, rows = scratch(spark, "store"), table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("run_id"))
    parts = [rows.where(f"o_orderkey % 3 = {k}") for k in range(3)]
    parts[2].write.partitionBy("run_id").parquet(f"{path}/data/batch-2-broken")
    for k in (0, 1, 0, 1, 2):
        sinks.store_append(parts[k], path, f"batch-{k}")
    return sinks.store_read(spark, path, rows.schema)


@query("select c_custkey, 'r1' as run_id from customer")
def save_report(spark, sf_dir):
    path = scratch(spark, "report")
    sinks.save_report(table(spark, sf_dir, "customer").select("c_custkey"), path, "r1")
    return spark.read.schema("c_custkey bigint, run_id string").json(path)


@query("select vec_id, round(list_sum(embedding::double[]), 4) + 0.0 as total from embeddings")
def save_vectors(spark, sf_dir):
    path = scratch(spark, "vectors")
    sinks.save_vectors(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).select("vec_id", sinks.vector_text("v").alias("t")), path)
    rows = sinks.load(spark, path, "vec_id bigint, t string").withColumn("v", sinks.parse_vector("t"))
    return rows.select("vec_id", tidy(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("select n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' as json from nation")
def export_json(spark, sf_dir):
    return V.export_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


# --- projections, slices, alignment


@query(f"""with {E} select symbol, ts, close >= open as is_green, close < open as is_red, round(abs(close - open), 6) + 0.0 as wax_height, round((open + close) / 2, 6) as wax_mid,
    round(high - greatest(open, close), 6) + 0.0 as upper_wick, round(least(open, close) - low, 6) + 0.0 as lower_wick,
    least(open, close) < 50 and 50 < greatest(open, close) as contains_50, high > greatest(open, close) and least(open, close) = low as upper_only from bars""")
def bar_shape(spark, sf_dir):
    return B.bars_events(spark, sf_dir).select(
        "symbol", "ts", S.is_green().alias("is_green"), (~S.is_green()).alias("is_red"), tidy(S.wax_height()).alias("wax_height"), tidy((S.wax_top() + S.wax_bottom()) / 2).alias("wax_mid"),
        tidy(S.upper_wick()).alias("upper_wick"), tidy(S.lower_wick()).alias("lower_wick"), S.wax_contains(F.lit(50.0)).alias("contains_50"), ((S.upper_wick() > 0) & (S.wax_bottom() == F.col("low"))).alias("upper_only"),
    )


@query(f"with {E} select symbol, ts, case when close - open >= 0 then 'Buy' else 'Sell' end as bias, 'Open' as time_of_day, 1.0::double as size_pct from bars")
def to_signal(spark, sf_dir):
    df = B.bars_events(spark, sf_dir).withColumn("x", F.col("close") - F.col("open"))
    return T.signals(df, "x").drop("stop", "limit")


@query(f"with {E} select symbol as feature, ts, close as value from bars")
def tag_feature(spark, sf_dir):
    return B.bars_events(spark, sf_dir).select(F.col("symbol").alias("feature"), "ts", F.col("close").alias("value"))


@query(f"with {E}, {P} select symbol, ts, pos >= 10 as has_low, close > open as has_high from p")
def bi_present(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("low_", F.when(F.col("pos") >= 10, F.col("low"))).withColumn("high_", F.when(F.col("close") > F.col("open"), F.col("high")))
    return df.select("symbol", "ts", F.col("low_").isNotNull().alias("has_low"), F.col("high_").isNotNull().alias("has_high"))


def slice_sql(where: str, pre: str = "") -> str:
    return f"with {O_}, {P}{pre} select symbol, ts, close from {'q' if pre else 'p'} where {where}"


def closes_of(df: DataFrame) -> DataFrame:
    return df.select("symbol", "ts", "close")


@query(slice_sql("ts between '1996-03-01' and '1997-03-01'"))
def date_range(spark, sf_dir):
    return closes_of(A.date_range(orders(spark, sf_dir), "1996-03-01", "1997-03-01"))


@query(slice_sql("ts >= date '1997-01-01' - interval 100 day and ts <= date '1997-06-01' + interval 7 day"))
def crop_with_margin(spark, sf_dir):
    return closes_of(A.crop_with_margin(orders(spark, sf_dir), "1997-01-01", "1997-06-01"))


@query(slice_sql("pos between a and b", ", q as (select *, min(pos) filter (ts >= '1996-03-02') over (partition by symbol) as a, max(pos) filter (ts <= '1997-03-03') over (partition by symbol) as b from p)"))
def index_window(spark, sf_dir):
    return closes_of(A.index_window(orders(spark, sf_dir), "1996-03-02", "1997-03-03"))


@query(slice_sql("pos >= a and pos < a + greatest(1, least(n - a, floor(n * 0.3)))", ", q0 as (select *, count(*) over (partition by symbol) as n from p), q as (select *, greatest(0, least(n - 1, floor(n * 0.25))) as a from q0)"))
def fraction_window(spark, sf_dir):
    return closes_of(A.fraction_window(orders(spark, sf_dir), 0.25, 0.3))


@query(f"with {O_}, {P}, q as (select *, case when pos < 5 or volume = 1 then 0.0 else close end as x from p), k as (select *, min(ts) filter (x <> 0) over s as a, max(ts) filter (x <> 0) over s as b from q window s as (partition by symbol)) select symbol, ts, x from k where ts between a and b")
def trim_value(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("x", F.when((F.col("pos") < 5) | (F.col("volume") == 1), 0.0).otherwise(F.col("close")))
    return A.trim_value(df, "x", 0.0).select("symbol", "ts", "x")


@query(f"with {O_} select symbol, ts, case when ts::date <= date '1996-01-01' + floor(datediff('day', date '1996-01-01', date '1998-01-01') * (1 - 0.3))::int then 'train' else 'validation' end as part from bars where ts between '1996-01-01' and '1998-01-01'")
def split_by_date(spark, sf_dir):
    return A.split_by_date(orders(spark, sf_dir), "1996-01-01", "1998-01-01", 0.3).select("symbol", "ts", "part")


@query(f"with {O_}, {P} select symbol, ts, least(floor(pos / greatest(1, floor(count(*) over (partition by symbol) / 7))), 6)::int as part, pos < floor(count(*) over (partition by symbol) * 0.8) as train from p")
def split_by_rows(spark, sf_dir):
    return A.train_share(A.split_by_rows(orders(spark, sf_dir), 7)).select("symbol", "ts", "part", "train")


@query(slice_sql("pos >= 20"))
def skip_preload(spark, sf_dir):
    return closes_of(orders(spark, sf_dir).where("pos >= 20"))


@query(f"with {O_} select symbol, ts, close from bars where not isnan(close)")
def reject_nan(spark, sf_dir):
    return closes_of(A.reject_nan(B.bars_orders(spark, sf_dir), ["open", "close"]))


ALIGNED = f"""{O_}, cal as (select ts from bars where symbol = '1-URGENT'), names as (select distinct symbol from bars where symbol <> '1-URGENT'),
    g as (select names.symbol, cal.ts, b.open, b.high, b.low, b.close, b.volume, b.ts is null as filled from cal cross join names left join bars b on b.symbol = names.symbol and b.ts = cal.ts),
    al as (select symbol, ts, filled, {', '.join(f"coalesce(last_value({c} ignore nulls) over (partition by symbol order by ts rows unbounded preceding), first_value({c} ignore nulls) over (partition by symbol order by ts rows between current row and unbounded following)) as {c}" for c in A.FIELDS)} from g)"""


@query(f"with {ALIGNED} select symbol, ts, open, high, low, close, volume, filled from al")
def align_calendar(spark, sf_dir):
    return A.align_calendar(B.bars_orders(spark, sf_dir), "1-URGENT", OTHERS)


@query(f"with {ALIGNED} select x.pos, x.close as x, y.close as y from (select *, row_number() over (order by ts) - 1 as pos from al where symbol = '2-HIGH') x join (select *, row_number() over (order by ts) - 1 as pos from al where symbol = '5-LOW') y on x.pos = y.pos")
def zip_series(spark, sf_dir):
    al = W.with_pos(A.align_calendar(B.bars_orders(spark, sf_dir), "1-URGENT", OTHERS))
    return A.zip_series(al.where("symbol = '2-HIGH'"), al.where("symbol = '5-LOW'"), "close", "close")


@query(f"with {sql.TRADES}, e as (select symbol, min(ts) as a, max(ts) as b from t where profit > 0 group by 1), d as (select bars.symbol, bars.ts, t.entry, t.exit, t.value_after from bars join e on bars.symbol = e.symbol and bars.ts between a and b left join t on t.symbol = bars.symbol and t.ts = bars.ts and t.profit > 0), f as (select *, entry is null as is_fill, last_value(exit ignore nulls) over (partition by symbol order by ts rows unbounded preceding) as last_exit, last_value(value_after ignore nulls) over (partition by symbol order by ts rows unbounded preceding) as v from d) select symbol, ts, case when is_fill then last_exit else entry end as entry, last_exit as exit, round(v, 2) as value_after, is_fill from f")
def trades_on_calendar(spark, sf_dir):
    """A log that holds winning trades only, so that the days of the others are filled."""
    own = trades(spark, sf_dir).where("profit > 0")
    return T.trades_on_calendar(B.bars_orders(spark, sf_dir), own).withColumn("value_after", F.round("value_after", 2))


@query(f"with {sql.TRADES}, e as (select symbol, min(ts) as a, max(ts) as b from t where profit > 0 group by 1), d as (select bars.symbol, bars.ts, t.entry, t.exit, t.unstopped_exit, t.value_after from bars join e on bars.symbol = e.symbol and bars.ts between a and b left join t on t.symbol = bars.symbol and t.ts = bars.ts and t.profit > 0), f as (select *, entry is null as is_fill, last_value(unstopped_exit ignore nulls) over (partition by symbol order by ts rows unbounded preceding) as u, last_value(value_after ignore nulls) over (partition by symbol order by ts rows unbounded preceding) as v from d) select symbol, ts, case when is_fill then u else entry end as entry, case when is_fill then u else exit end as exit, round(v, 2) as value_after, is_fill from f")
def trades_on_calendar_unstopped(spark, sf_dir):
    own = trades(spark, sf_dir).where("profit > 0")
    return T.trades_on_calendar(B.bars_orders(spark, sf_dir), own, unstopped=True).withColumn("value_after", F.round("value_after", 2))


@query(f"with {O_} select l.o_orderkey, b.symbol, b.close from orders l join bars b on b.ts = date_trunc('day', l.o_orderdate) where b.symbol = '5-LOW'")
def lookup_bar(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select("o_orderkey", F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts"))
    return T.lookup_bar(log, B.bars_orders(spark, sf_dir).where("symbol = '5-LOW'")).select("o_orderkey", "symbol", "close")


@query(f"with {O_} select ts, count(*)::bigint as n, string_agg(symbol, ',' order by symbol) as symbols, round(sum(close), 2) as total from bars group by 1")
def mesh_series(spark, sf_dir):
    rows = A.mesh(B.bars_orders(spark, sf_dir))
    total = F.aggregate(F.transform("present", lambda x: x["value"]), F.lit(0.0), lambda a, x: a + x)
    return rows.select("ts", F.size("present").cast("bigint").alias("n"), F.array_join(F.transform("present", lambda x: x["symbol"]), ",").alias("symbols"), F.round(total, 2).alias("total"))


@query(f"with {O_}, s as (select ts, row_number() over (order by ts) - 1 as slot from (select distinct ts from bars)) select symbol, min(slot) as \"left\", min(slot) + count(*) - 1 as \"right\" from bars join s using (ts) group by 1")
def series_extents(spark, sf_dir):
    return A.series_extents(B.bars_orders(spark, sf_dir))


@query(f"with {E}, {P} select b.symbol, b.ts, s.close - s.open as signal from p b join p s on b.symbol = s.symbol and b.ts = s.ts and s.pos >= 15")
def align_from_first_signal(spark, sf_dir):
    df = events(spark, sf_dir)
    signals = df.where("pos >= 15").withColumn("signal", F.col("close") - F.col("open"))
    return A.from_first_signal(df, signals).select("symbol", "ts", "signal")


@query(f"with {O_}, {P} select pos, close as value, place from (select pos, close, case when pos < m then 2 * pos + src else m + pos end as place from (select *, (symbol = '5-LOW')::int as src, least((select count(*) from bars where symbol = '1-URGENT'), (select count(*) from bars where symbol = '5-LOW')) as m from p where symbol in ('1-URGENT', '5-LOW')))")
def interleave(spark, sf_dir):
    df = orders(spark, sf_dir).select("symbol", "pos", F.col("close").alias("value"))
    return A.interleave(df.where("symbol = '1-URGENT'").drop("symbol"), df.where("symbol = '5-LOW'").drop("symbol")).drop("source")


# --- entities: runs are customers' nations, generations their order years, mixtures their customers


@query("""with o as (select o_orderkey, o_totalprice, o_orderstatus, o_custkey, c_nationkey as run_id, extract(year from o_orderdate)::bigint as generation from orders join customer on o_custkey = c_custkey),
    g as (select run_id, generation, max(o_totalprice) > 1.8::double * avg(o_totalprice) as evaluated, max(o_totalprice) as fitness from o group by 1, 2),
    good as (select run_id from g group by 1 having bool_and(evaluated)),
    m as (select run_id, generation, o_custkey as mixture_id, max(o_totalprice) as fitness, string_agg((case when o_orderstatus = 'F' then 'rbf' else 'rnn' end) || o_orderkey, ' ' order by o_orderkey) as experts from o group by 1, 2, 3),
    p as (select *, (row_number() over (partition by run_id, generation order by mixture_id) - 1) // 8 as part from m)
    select p.run_id, p.generation, p.part, round(any_value(g.fitness), 2) as fitness, string_agg(mixture_id || ': ' || experts, '; ' order by mixture_id) as mixtures
    from p join good on p.run_id = good.run_id join g on g.run_id = p.run_id and g.generation = p.generation group by 1, 2, 3""")
def entity_tree(spark, sf_dir):
    """Generations are evaluated where their largest order is over 1.8 times the average one; experts are orders, of a kind by status."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", "o_totalprice", "o_orderstatus", F.col("o_custkey").alias("customer"), F.col("c_nationkey").cast("bigint").alias("run_id"), F.year("o_orderdate").cast("bigint").alias("generation"))
    o = o.withColumn("generation_id", F.col("run_id") * 10_000 + F.col("generation")).withColumn("mixture_id", F.col("generation_id") * 1_000_000_000 + F.col("customer"))
    generations, mixtures = o.select("generation_id", "run_id", "generation").distinct(), o.select("mixture_id", "generation_id").distinct()
    gen_evals = o.groupBy("generation_id").agg(F.max("o_totalprice").alias("fitness"), F.avg("o_totalprice").alias("mean")).where("fitness > 1.8D * mean").drop("mean")
    expert = lambda kind, rows: rows.select("mixture_id", F.col("o_orderkey").cast("bigint").alias("ord"), F.lit(kind).alias("kind"), F.col("o_orderkey").cast("bigint").alias("id"))
    experts = V.experts_of_mixture(expert("rbf", o.where("o_orderstatus = 'F'")), expert("rnn", o.where("o_orderstatus <> 'F'")))
    tree = V.entity_tree(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("run_id")), generations, gen_evals, mixtures, o.groupBy("mixture_id").agg(F.max("o_totalprice").alias("fitness")), experts, 8)
    ids = lambda m: F.array_join(F.transform(m["experts"], lambda e: F.concat(e["kind"], e["id"].cast("string"))), " ")
    text = F.array_join(F.transform("mixtures", lambda m: F.concat((m["mixture_id"] % 1_000_000_000).cast("string"), F.lit(": "), ids(m))), "; ")
    return tree.select("run_id", "generation", "part", F.round("fitness", 2).alias("fitness"), text.alias("mixtures"))


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.groupBy(F.col("c_nationkey").alias("run_id"), F.year("o_orderdate").cast("bigint").alias("generation"), F.col("o_custkey").alias("mixture_id"))
    return rows.agg(F.round(F.max("o_totalprice"), 2).alias("fitness"))


EVALS = "ev as (select c_nationkey as run_id, extract(year from o_orderdate)::bigint as generation, o_custkey as mixture_id, round(max(o_totalprice), 2) as fitness from orders join customer on o_custkey = c_custkey group by 1, 2, 3)"


@query("""with e as (select s_nationkey::bigint as mixture_id, s_suppkey as ord, 'rbf' as kind from supplier union all select c_nationkey, c_custkey, 'rnn' from customer),
    p as (select *, (row_number() over (partition by mixture_id order by ord, kind) - 1) // 16 as part from e)
    select mixture_id, part, count(*) as n, string_agg(kind || ord, ' ' order by ord, kind) as experts from p group by 1, 2""")
def experts_of_mixture(spark, sf_dir):
    """Experts of two tables in the order they have in their mixture, 16 a row."""
    kind = lambda name, nation, key, kind: table(spark, sf_dir, name).select(F.col(nation).cast("bigint").alias("mixture_id"), F.col(key).cast("bigint").alias("ord"), F.lit(kind).alias("kind"))
    both = V.experts_of_mixture(kind("supplier", "s_nationkey", "s_suppkey", "rbf"), kind("customer", "c_nationkey", "c_custkey", "rnn"))
    rows = V.in_blocks(both, ["mixture_id"], "ord", ["kind"], "experts", 16)
    text = F.array_join(F.transform("experts", lambda e: F.concat(e["kind"], e["ord"].cast("string"))), " ")
    return rows.select("mixture_id", "part", F.size("experts").cast("bigint").alias("n"), text.alias("experts"))


@query("select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey")
def gene_spec_lookup(spark, sf_dir):
    specs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name"), "n_name")
    return G.gene_spec(table(spark, sf_dir, "customer").withColumn("name", F.col("c_nationkey")), specs).select("c_custkey", "n_name")


@query("select n_nationkey, a, b from nation, (select unnest(range(0, 9)) * 0.5::double + 1 as a), (select unnest(range(0, 5)) * 2.0::double as b)")
def param_grid(spark, sf_dir):
    grid = G.param_grid(spark, {"a": (1.0, 5.0, 0.5), "b": (0.0, 8.0, 2.0)})
    return table(spark, sf_dir, "nation").select("n_nationkey").join(grid)


def values_of(rows: DataFrame, vector: Column) -> DataFrame:
    return rows.select("vec_id", F.posexplode(vector).alias("k", "x")).select("vec_id", "k", tidy(F.col("x").cast("double")).alias("value"))


@query("select vec_id, (i - 1)::int as k, round(embedding[i]::double, 6) + 0.0 as value from (select *, unnest(range(1, len(embedding) + 1)) as i from embeddings)")
def flatten_population(spark, sf_dir):
    return values_of(table(spark, sf_dir, "embeddings"), F.col("embedding"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def outstanding_work(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# --- trades and reports


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sign of the last bar's momentum held for a session, 100 shares, the last bar's opening wick as stop."""
    def sides(d: DataFrame) -> DataFrame:
        d = O.momentum(d, "close", 10, "m").withColumn("wick", S.opening_wick())
        return d.withColumn("side", F.when(W.lagged("m", 1) >= 0, "long").otherwise("short")).withColumn("pw", W.lagged("wick", 1))

    df = halo(orders(spark, sf_dir), 11, ROWS, sides).where("pos >= 1")
    df = df.withColumn("size", F.lit(100)).withColumn("stop", F.when(F.col("side") == "long", F.col("open") - F.col("pw")).otherwise(F.col("open") + F.col("pw")))
    return T.equity_curve(T.trade_pnl(T.session_exit(df)), INITIAL)


def from_trades(columns: str) -> str:
    return f"with {sql.TRADES} select symbol, ts, {columns} from t"


@query(from_trades("side, entry, exit, stopped, date_trunc('day', ts) + interval 9 hour + interval 30 minute as entry_time, date_trunc('day', ts) + interval 16 hour as exit_time"))
def session_exit(spark, sf_dir):
    return trades(spark, sf_dir).select("symbol", "ts", "side", "entry", "exit", "stopped", "entry_time", "exit_time")


@query(from_trades("round(profit, 2) as profit"))
def trade_pnl(spark, sf_dir):
    return trades(spark, sf_dir).select("symbol", "ts", F.round("profit", 2).alias("profit"))


@query(from_trades("round(value_before, 2) as value_before, round(value_after, 2) as value_after"))
def equity_curve(spark, sf_dir):
    return trades(spark, sf_dir).select("symbol", "ts", F.round("value_before", 2).alias("value_before"), F.round("value_after", 2).alias("value_after"))


@query(from_trades("round(profit, 2) as value"))
def trade_series(spark, sf_dir):
    return trades(spark, sf_dir).select("symbol", F.to_date("entry_time").cast("timestamp_ntz").alias("ts"), F.round("profit", 2).alias("value"))


@query(from_trades("round(-profit, 2) + 0.0 as loss, round(profit / value_before, 8) + 0.0 as pct_profit, round(-profit / value_before, 8) + 0.0 as pct_loss, profit > 0 as is_win, stopped and profit > 0 as is_stopped_gain"))
def trade_derived(spark, sf_dir):
    df = T.derived(trades(spark, sf_dir))
    return df.select("symbol", "ts", tidy("loss", 2).alias("loss"), tidy("pct_profit", 8).alias("pct_profit"), tidy("pct_loss", 8).alias("pct_loss"), "is_win", "is_stopped_gain")


@query(from_trades("case when profit <= 0 then entry else exit end as exit, round(case when profit <= 0 then 0 else profit end, 2) as profit"))
def ignore_gains_losses(spark, sf_dir):
    return T.flat(trades(spark, sf_dir), losses=True).select("symbol", "ts", "exit", F.round("profit", 2).alias("profit"))


@query(f"with {sql.TRADES} select symbol, ts, round(size * entry, 2) as cost, round(value_before * 0.02, 2) as power from t where size * entry > value_before * 0.02")
def buying_power_check(spark, sf_dir):
    bad = T.buying_power_violations(trades(spark, sf_dir), 0.02, F.lit(0.0))
    return bad.select("symbol", "ts", F.round("cost", 2).alias("cost"), F.round("power", 2).alias("power"))


@query(from_trades("floor(((value_before - 5) * 4 - 1000) / entry)::bigint as shares"))
def max_shares(spark, sf_dir):
    return trades(spark, sf_dir).select("symbol", "ts", T.max_shares(F.col("value_before"), 4.0, 5.0, F.col("entry"), F.lit(1000.0)).alias("shares"))


REPORT = f"""with {sql.TRADES}, g as (select symbol, count(*) as trades, count(*) filter (profit > 0) as wins, count(*) filter (profit <= 0) as losses, (1e9 + sum(profit)) / 1e9 as total_return,
    sum(case when profit > 0 then profit else 0 end) as total_profit, sum(case when profit <= 0 then -profit else 0 end) + 9.9 * count(*) as total_loss,
    avg(profit) filter (profit > 0) as avg_win, avg(-profit) filter (profit <= 0) as avg_loss, count(*) filter (profit > 0 and stopped) as stopped_gains,
    count(*) filter (profit <= 0 and stopped) as stopped_losses, count(*) filter (profit <= 0 and not stopped) as unstopped_losses, max(-profit / value_before) as max_pct_loss from t group by 1)"""


REPORTED = """ select symbol, trades, wins, losses, round(total_return, 6) as total_return, round(total_profit, 1) as total_profit, round(total_loss, 1) as total_loss, round(total_profit / total_loss, 6) as profit_factor,
    round(avg_win, 2) as avg_win, round(avg_loss, 2) as avg_loss, stopped_gains, stopped_losses, unstopped_losses, round(max_pct_loss, 8) as max_pct_loss, round(wins / trades, 6) as win_fraction, round(avg_win / avg_loss, 6) as avg_win_loss_ratio,
    round(total_profit / total_loss * (wins / trades) * (avg_win / avg_loss), 6) as cpc from g"""


def reported(report: DataFrame) -> DataFrame:
    digits = {"total_profit": 1, "total_loss": 1, "avg_win": 2, "avg_loss": 2, "max_pct_loss": 8, "total_return": 6, "profit_factor": 6, "win_fraction": 6, "avg_win_loss_ratio": 6, "cpc": 6}
    return report.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(REPORT + REPORTED)
def trade_report(spark, sf_dir):
    return reported(T.trade_report(trades(spark, sf_dir), INITIAL))


@query(REPORT + """ select symbol, symbol || ': ' || trades || ' trades, ' || wins || ' won, ' || losses || ' lost, ' || stopped_gains || ' gains stopped, ' || stopped_losses || ' losses stopped, ' || unstopped_losses || ' not' as counts,
    round(total_return, 4) as total_return, round(total_profit / total_loss, 4) as profit_factor, round(wins / trades, 4) as win_fraction, round(avg_win / avg_loss, 4) as win_loss_ratio, round(total_profit / total_loss * (wins / trades) * (avg_win / avg_loss), 4) as cpc, round(max_pct_loss, 6) as max_pct_loss from g""")
def report_text(spark, sf_dir):
    """The printed report read back: its words as they are, its numbers as numbers."""
    text = T.report_text(T.trade_report(trades(spark, sf_dir), INITIAL))
    number = lambda name, digits: F.round(F.regexp_extract("report", name + r": (-?[0-9.]+)", 1).try_cast("double"), digits)
    named = {"total_return": ("Return", 4), "profit_factor": ("Profit factor", 4), "win_fraction": ("Win fraction", 4), "win_loss_ratio": ("Win/loss ratio", 4), "cpc": ("CPC index", 4), "max_pct_loss": ("Largest loss", 6)}
    return text.select("symbol", F.substring_index("report", "\n", 1).alias("counts"), *[number(*x).alias(c) for c, x in named.items()])


@query(REPORT.replace("from t group by 1", "from (select * from t where ts between '1996-01-01' and '1999-12-31') group by 1") + REPORTED)
def trade_blotter(spark, sf_dir):
    return reported(T.trade_report(A.date_range(trades(spark, sf_dir), "1996-01-01", "1999-12-31"), INITIAL))


def drawdown_sql(include_open: bool) -> str:
    where = "true" if include_open else "ep < last"
    return f"""with {E}, {P}, a as (select *, max(close) over ({sql.LINE} rows between unbounded preceding and 1 preceding) as pk from p),
        b as (select *, sum(case when pk is null or close >= pk then 1 else 0 end) over ({sql.LINE} rows unbounded preceding) as ep from a),
        c as (select symbol, ep, max(close) as hi, min(close) as lo from b group by 1, 2),
        d as (select *, max(ep) over (partition by symbol) as last, max(hi) over (partition by symbol order by ep) as top from c)
        select symbol, round(coalesce(max((top - lo) / nullif(top, 0)) filter ({where}), 0), 6) as max_drawdown from d group by 1"""


@query(drawdown_sql(False))
def max_drawdown(spark, sf_dir):
    return T.max_drawdown(events(spark, sf_dir), "close").withColumn("max_drawdown", F.round("max_drawdown", 6))


@query(drawdown_sql(True))
def max_drawdown_open(spark, sf_dir):
    return T.max_drawdown(events(spark, sf_dir), "close", True).withColumn("max_drawdown", F.round("max_drawdown", 6))


@query(f"""with recursive {sql.TRADES}, f as (select symbol, row_number() over ({sql.LINE}) - 1 as pos, case when profit > 0 then 0.0 else 10.0 end as x from t),
    h as (select *, lag(x, 10) over (partition by symbol order by pos) as old from f),
    r as (select symbol, pos, x::double as v from h where pos = 0 union all select b.symbol, b.pos, (case when b.pos < 10 then (r.v * (b.pos + 1) + b.x) / (b.pos + 2) else r.v + (b.x - b.old) / 10 end)::double from r join h b on b.symbol = r.symbol and b.pos = r.pos + 1)
    select symbol, max(floor(v + 1e-9))::int as max_losses from r group by 1""")
def max_losses_10(spark, sf_dir):
    return T.max_losses(W.with_pos(trades(spark, sf_dir).drop("pos")))


SIGNALLED = f"{E}, {P}, sg as (select *, sign(coalesce(lag(close - open) over ({sql.LINE}), 0)) as sig from p), ac as (select *, case when sig = 0 then 0 when (close >= open) = (sig > 0) then 1 else -1 end as hit from sg)"


def signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.signum(F.coalesce(F.lag(F.col("close") - F.col("open")).over(W.line()), F.lit(0.0)))
    return T.signal_accuracy(halo(events(spark, sf_dir), 1, ROWS, lambda d: d.withColumn("sig", last)), "sig", "hit")


@query(f"with {SIGNALLED} select symbol, ts, hit::int as hit from ac")
def signal_accuracy(spark, sf_dir):
    return signalled(spark, sf_dir).select("symbol", "ts", "hit")


@query(f"with {SIGNALLED} select symbol, count(*) filter (hit <> 0) as n, round(count(*) filter (hit = 1) / nullif(count(*) filter (hit <> 0), 0), 6) as accuracy from ac group by 1")
def signal_accuracy_pct(spark, sf_dir):
    return T.accuracy_pct(signalled(spark, sf_dir), "hit", "symbol").withColumn("accuracy", F.round("accuracy", 6))


@query(f"with {SIGNALLED}, q as (select symbol, count(*) filter (hit = 1) / nullif(count(*) filter (hit <> 0), 0) as a, count(*) filter (hit <> 0) / count(*) as c from ac group by 1) select symbol, round(a, 6) as accuracy, round(c, 6) as confidence, round(a * c + 0.57 * (1 - c), 6) as overall from q")
def signal_quality(spark, sf_dir):
    return T.signal_quality(signalled(spark, sf_dir), "hit").select("symbol", *[F.round(c, 6).alias(c) for c in ("accuracy", "confidence", "overall")])


@query(f"with {E}, {P}, m as (select *, close - coalesce(lag(close, 10) over w, first_value(close) over w) as m, lead(close) over w - close as d from p window w as ({sql.LINE})) select symbol, round(avg(case when sign(m) = case when d >= 0 then 1 else -1 end then 1.0 else 0.0 end), 6) as fitness from m where d is not null and pos >= 20 group by 1")
def fitness(spark, sf_dir):
    df = called(spark, sf_dir).where("label is not null and pos >= 20")
    return M.fitness(df, "m", "label", "symbol").withColumn("fitness", F.round("fitness", 6))


@query(f"with {E} select symbol, round(sum(pow(close - open, 2)), 4) as squared_distance from bars group by 1")
def squared_distance(spark, sf_dir):
    return B.bars_events(spark, sf_dir).groupBy("symbol").agg(F.round(F.sum(F.pow(F.col("close") - F.col("open"), 2)), 4).alias("squared_distance"))


@query("select label, round(sum(list_sum(list_transform(embedding::double[], lambda x: pow(x - 0.1, 2)))), 4) as error from embeddings group by 1")
def output_error(spark, sf_dir):
    gap = F.aggregate(F.transform(F.col("embedding").cast("array<double>"), lambda x: F.pow(x - 0.1, 2.0)), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.sum(gap), 4).alias("error"))


@query(f"with {SIGNALLED}, st as (select symbol, case when sig > 0 then close / nullif(open, 0) else open / nullif(close, 0) end as s from ac) select symbol, round(sum(ln(s)), 4) + 0.0 as log_total, round(avg(case when s > 1 then 1.0 else 0.0 end) * 100, 6) as won_pct from st group by 1")
def compounded_return(spark, sf_dir):
    return T.compounded_return(signalled(spark, sf_dir), "sig").select("symbol", tidy(F.log("total"), 4).alias("log_total"), F.round("won_pct", 6).alias("won_pct"))


@query(f"with {SIGNALLED}, st as (select symbol, (lead(close) over ({sql.LINE}) - close) / nullif(close, 0) * (case when sig > 0 then 1 else -1 end) * 0.01 as r from ac) select symbol, round(product(1 + r), 6) as total, round(avg(case when r > 0 then 1.0 else 0.0 end), 6) as hit_rate, count(*)::bigint as n from st where r is not null group by 1")
def signal_backtest(spark, sf_dir):
    rows = T.signal_backtest(signalled(spark, sf_dir), "sig", 0.01)  # runs in buckets of its own
    return rows.select("symbol", F.round("total", 6).alias("total"), F.round("hit_rate", 6).alias("hit_rate"), "n")


@query(f"""with recursive {sql.ORDERS}, {P}, m as (select *, sign(close - open) as sig from p), h as (select *, lag(close) over ({sql.LINE}) as old, lag(case when sig > 0 then 1 else -1 end) over ({sql.LINE}) as side from m),
    r as (select symbol, pos, ts, 0::bigint as shares, 1e9::double as value from h where pos = 0
          union all select b.symbol, b.pos, b.ts, (b.side * greatest(0, floor(r.value / b.old)))::bigint, r.value + b.side * greatest(0, floor(r.value / b.old)) * (b.close - b.old) * 1.0 from r join h b on b.symbol = r.symbol and b.pos = r.pos + 1)
    select symbol, ts, shares, round(value, 2) as value from r""")
def whole_share_backtest(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("sig", F.signum(F.col("close") - F.col("open")))
    rows = T.whole_share_backtest(df, "sig", 1e9)
    return rows.select("symbol", "ts", "shares", F.round("value", 2).alias("value"))


def ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.element_at(F.array(*[F.lit(a) for a in ("buy", "sell", "short", "cover")]), (F.pmod(F.col("l_partkey"), F.lit(4)) + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("account"), F.col("l_returnflag").alias("symbol"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("bigint").alias("seq"), action.alias("action"), F.col("l_quantity").cast("bigint").alias("shares"), F.round(F.col("l_extendedprice") / F.greatest(F.col("l_quantity"), F.lit(1)), 2).alias("price"))
    # Lines that share account and seq are one order: the least of them, whichever comes first.
    rest = F.min(F.struct("symbol", "action", "shares", "price")).alias("o")
    return rows.groupBy("account", "seq").agg(rest).select("account", "o.symbol", "seq", "o.action", "o.shares", "o.price")


@query()
def position_ledger(spark, sf_dir):
    rows = T.position_ledger(ledger_orders(spark, sf_dir), 1e6, 4.0, 3.0)
    return rows.groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("rejected"), F.round(F.sum("realised"), 2).alias("realised"), F.round(F.max_by("equity", "seq"), 2).alias("equity"))


@query(f"""with {O_}, lg as (select symbol, ts, close - open as gain from bars where volume > 1), j as (select b.symbol, b.ts, b.open, b.high, b.low, b.close, lg.gain, case when (lg.gain > 0) = (b.close >= b.open) then 'long' else 'short' end as side from lg join bars b on lg.symbol = b.symbol and lg.ts = b.ts),
    x as (select *, case when gain > 0 then close when side = 'long' then greatest(low, open + gain) else least(high, open - gain) end as exit from j),
    y as (select *, 100 * (case when side = 'long' then exit - open else open - exit end) - 9.9 as profit from x)
    select symbol, ts, side, exit, round(profit, 2) as profit, round(1e9 + sum(profit) over ({sql.LINE} rows unbounded preceding), 2) as value_after from y""")
def discretionary_trades(spark, sf_dir):
    bars = B.bars_orders(spark, sf_dir)
    log = bars.where("volume > 1").select("symbol", "ts", (F.col("close") - F.col("open")).alias("gain"))
    rows = log.join(bars.drop("volume"), ["symbol", "ts"])
    done = T.discretionary_of(rows.withColumn("shares", F.lit(100)), INITIAL)
    return done.select("symbol", "ts", "side", "exit", F.round("profit", 2).alias("profit"), F.round("value_after", 2).alias("value_after"))


def sized_sql(gains: bool, losses: bool, slippage: bool, price: str) -> str:
    return f"""with recursive {sql.ORDERS}, {P}, lg as (select *, lead(close) over ({sql.LINE}) - open as gain from p),
        k as (select *, row_number() over ({sql.LINE}) - 1 as i, case when gain >= 0 then {gains} when gain < 0 then {losses} else false end as taken from lg),
        s as (select *, case when not taken then true when gain >= 0 then close >= open else close < open end as up from k),
        x as (select *, case when not taken then open when gain >= 0 and {slippage} then close when up then open + gain else open - gain end as leave from s),
        y as (select *, case when not taken then open when gain >= 0 then case when close >= open then low - 0.1 else high + 0.1 end else leave end as stop, (case when up then leave - open else open - leave end) * 0.01 as each from x),
        r as (select symbol, i, 1e6::double as before, trunc(1e6::double / {price})::bigint as size, 1e6::double + each * trunc(1e6::double / {price}) as after from y where i = 0
              union all select b.symbol, b.i, r.after, trunc(r.after / {price})::bigint, r.after + b.each * trunc(r.after / {price}) from r join y b on b.symbol = r.symbol and b.i = r.i + 1)
        select y.symbol, y.ts, case when up then 'long' else 'short' end as side, round(leave, 4) as exit, round(stop, 4) as stop, r.size, round(r.after, 4) as value_after from y join r on y.symbol = r.symbol and y.i = r.i"""


def sized(spark: SparkSession, sf_dir: str, *switches: bool, price: float | None = None) -> DataFrame:
    """A log whose gain is what the next close lies above the open; a margin of a hundredth keeps accounts within bounds.

    Prices are whole cents, so values are whole multiples of 0.0001 and none lies on a tie of that rounding. Long logs outgrow
    a bigint's numbers of shares, and SQL's cast fails there; such a size is null here, and the values go on.
    """
    gain = F.lead("close").over(W.line()) - F.col("open")
    log = halo(orders(spark, sf_dir), 0, ROWS, lambda d: d.withColumn("gain", gain), 1)
    rows = T.discretionary_sized(log, 1e6, 0.01, *switches, price=price)
    return rows.select("symbol", "ts", "side", F.round("exit", 4).alias("exit"), F.round("stop", 4).alias("stop"), F.col("size").try_cast("bigint").alias("size"), F.round("value_after", 4).alias("value_after"))


@query(sized_sql(True, True, False, "open"))
def discretionary_sized(spark, sf_dir):
    return sized(spark, sf_dir, True, True, False)


@query(sized_sql(True, False, True, "150000"))
def discretionary_sized_gains(spark, sf_dir):
    """Losses recorded flat, gains leave at the close, sizes from a fixed price."""
    return sized(spark, sf_dir, True, False, True, price=150000.0)


@query(f"""with recursive {sql.ORDERS}, {P}, q as (select *, case when close >= open then open - low else high - open end as wick, greatest(high - low, coalesce(abs(low - lag(close) over w), 0), coalesce(abs(high - lag(close) over w), 0)) as tr from p window w as ({sql.LINE})),
    r as (select symbol, pos, ts, open, close, wick as e, tr as a from q where pos = 0
          union all select b.symbol, b.pos, b.ts, b.open, b.close, 0.25 * b.wick + 0.75 * r.e, ((least(b.pos + 1, 7) - 1) * r.a + b.tr) / least(b.pos + 1, 7) from r join q b on b.symbol = r.symbol and b.pos = r.pos + 1),
    k as (select *, 1.2 * (0.65 * e + 0.35 * a) as risk from r)
    select symbol, ts, round(0.025 / nullif(risk, 0), 8) + 0.0 as size_pct, round(case when close >= open then open - risk else open + risk end, 4) + 0.0 as stop from k""")
def risk_sizing(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("side", F.when(S.is_green(), "long").otherwise("short"))
    df = R.atr(R.ema(df, S.opening_wick(), 7, "wick7"), 7, "atr7")
    return T.risk_sizing(df, "wick7", "atr7").select("symbol", "ts", tidy("size_pct", 8).alias("size_pct"), tidy("stop", 4).alias("stop"))


# --- aggregates and selection


@query(f"with {EVALS} select run_id, generation, max(fitness) as best from ev group by 1, 2")
def generation_best(spark, sf_dir):
    return V.fitness_series(evals(spark, sf_dir)).withColumnRenamed("fitness", "best")


@query(f"with {EVALS} select run_id, max(fitness) as best from ev group by 1")
def run_best(spark, sf_dir):
    return evals(spark, sf_dir).groupBy("run_id").agg(F.max("fitness").alias("best"))


@query(f"with {EVALS} select run_id, arg_max(mixture_id, (fitness, -mixture_id)) as mixture_id, max(fitness) as fitness from ev group by 1")
def best_mixture(spark, sf_dir):
    return G.best_mixture(evals(spark, sf_dir))


@query(f"with {E} select symbol, min(low) as low, max(high) as high from bars where ts >= '2024-01-10' group by 1")
def visible_bounds(spark, sf_dir):
    return A.visible_bounds(B.bars_events(spark, sf_dir), F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))


@query(f"with {O_}, m as (select symbol, date_trunc('month', ts)::timestamp as month, min(ts) as first_ts from bars group by 1, 2), n as (select *, row_number() over (partition by symbol order by month) as k from m) select symbol, month, first_ts from n where k > 1")
def month_first_bars(spark, sf_dir):
    return A.month_first(B.bars_orders(spark, sf_dir))


@query("select distinct o_orderpriority, o_orderstatus from orders")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus").distinct()


@query("select vec_id, round(list_reduce(list_prepend(1.0::double, embedding::double[]), lambda a, x: a * 0.5 + x), 6) + 0.0 as folded from embeddings")
def list_fold(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", tidy(F.aggregate("embedding", F.lit(1.0), lambda a, x: a * 0.5 + x)).alias("folded"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def top_k_by_fitness(spark, sf_dir):
    return G.top_k(table(spark, sf_dir, "orders"), 20, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) where k <= 3")
def top_k_per_run(spark, sf_dir):
    return G.top_k(table(spark, sf_dir, "orders"), 3, "o_totalprice", "o_orderkey", "o_custkey").select("o_custkey", "o_orderkey")


@query(f"with {EVALS} select run_id, mixture_id, max(fitness) as fitness from ev group by 1, 2 order by 3 desc")
def rank_reports(spark, sf_dir):
    return evals(spark, sf_dir).groupBy("run_id", "mixture_id").agg(F.max("fitness").alias("fitness")).orderBy(F.col("fitness").desc())


@query("select c_nationkey, arg_min(c_custkey, (c_acctbal, c_custkey)) as best, min(c_acctbal) as cost from customer group by 1")
def best_of_trials(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("best"), F.min("c_acctbal").alias("cost"))


@query("select p_partkey, round(pow(p_size / 50.0, 2) * p_retailprice, 4) as estimate from part order by 2 desc")
def order_by_cost_estimate(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.round(F.pow(F.col("p_size") / 50.0, 2) * F.col("p_retailprice"), 4).alias("estimate"))
    return rows.orderBy(F.col("estimate").desc())


@query(f"with {E} select symbol, ts, close from bars order by ts desc")
def reverse_series(spark, sf_dir):
    return closes_of(B.bars_events(spark, sf_dir)).orderBy(F.col("ts").desc())


@query(f"with {E} select symbol, ts, close from bars where symbol = 'click' union all select symbol, ts, close from bars where symbol = 'view'")
def concat_rows(spark, sf_dir):
    df = closes_of(B.bars_events(spark, sf_dir))
    return df.where("symbol = 'click'").unionByName(df.where("symbol = 'view'"))


@query("select c_nationkey from customer where c_acctbal < 0 except all select s_nationkey from supplier")
def except_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_nationkey").exceptAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("select c_custkey from customer order by ('0x' || substr(md5('7:' || c_custkey), 1, 8))::bigint, c_custkey")
def shuffle(spark, sf_dir):
    return A.shuffled(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 7)


# --- vectors and models


@query("select vec_id, round(list_sum(list_transform(embedding::double[], lambda x: x * x)), 6) as dot, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as norm from embeddings", "dot_norm2")
def dot_norm2(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return df.select("vec_id", F.round(S.dot("v", "v"), 6).alias("dot"), F.round(S.norm2("v"), 6).alias("norm"))


@query("select vec_id, 128::bigint as n, round(64 - list_sum(embedding::double[]), 4) as tail from embeddings")
def complement_code(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("c", S.complement_code(F.col("embedding").cast("array<double>")))
    return df.select("vec_id", F.size("c").cast("bigint").alias("n"), F.round(F.aggregate(F.slice("c", 65, 64), F.lit(0.0), lambda a, x: a + x), 4).alias("tail"))


@query("select vec_id, round(list_sum(list_slice(embedding, 1, 10)::double[]), 5) + 0.0 as total from embeddings")
def feature_subset(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("c", M.feature_subset(F.col("embedding").cast("array<double>"), 10))
    return df.select("vec_id", tidy(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def column_totals(rows: DataFrame) -> DataFrame:
    turned = M.transpose(rows.select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("values")))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return turned.groupBy("col").agg(F.sum(F.size("values")).cast("bigint").alias("n"), tidy(F.sum(total), 4).alias("total"))


@query("select (i - 1)::int as col, count(*) as n, round(sum(embedding[i]::double), 4) + 0.0 as total from (select *, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by 1")
def series_to_matrix(spark, sf_dir):
    return column_totals(table(spark, sf_dir, "embeddings"))


def pca_sql(d: int, vectors: str, k: int, rounds: int = 14) -> str:
    """CTEs v1 .. vk (v): principal directions of x (v), one after the other: covariances squared again and again, then without what was found."""
    trace = f"list_sum(list_transform(range(1, {d + 1}), lambda i: m[i][i]))"
    scaled = f"list_transform(m, lambda r: list_transform(r, lambda c: c / {trace}))"
    out = f"""x as ({vectors}), g as (select i, j, avg(v[i] * v[j]) - avg(v[i]) * avg(v[j]) as c from x, range(1, {d + 1}) t(i), range(1, {d + 1}) u(j) group by 1, 2),
        c1 as (select list(r order by i) as m from (select i, list(c order by j) as r from g group by 1))"""
    for n in range(1, k + 1):
        out += f""", p{n} as (select 0 as k, {scaled} as m from c{n}
            union all select k, {scaled} from (select k + 1 as k, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b))) as m from p{n} where k < {rounds})),
            q{n} as (select m, list_transform(range(1, {d + 1}), lambda i: m[i][i]) as z from p{n} where k = {rounds}),
            w{n} as (select m[list_position(z, list_max(z))::int] as w from q{n}), v{n} as (select list_transform(w, lambda c: c / sqrt(list_dot_product(w, w))) as v from w{n}),
            c{n + 1} as (select list_transform(range(1, {d + 1}), lambda i: list_transform(range(1, {d + 1}), lambda j: m[i][j] - l * v[i] * v[j])) as m
                         from (select m, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) as l from c{n}, v{n}))"""
    return out


ALL_64 = pca_sql(64, "select embedding::double[] as v from embeddings", 4)


@query(f"with recursive {ALL_64}, e as (select vec_id, embedding::double[] as e from embeddings) select vec_id, {', '.join(f'round(abs(list_dot_product(e, v{i + 1}.v)), 4) + 0.0 as c{i}' for i in range(4))} from e, v1, v2, v3, v4")
def pca_basis(spark, sf_dir):
    basis = M.pca_basis(table(spark, sf_dir, "embeddings"), "embedding", 4)
    return table(spark, sf_dir, "embeddings").select("vec_id", *[tidy(F.abs(S.dot(F.col("embedding").cast("array<double>"), F.array(*[F.lit(v) for v in b]))), 4).alias(f"c{i}") for i, b in enumerate(basis)])


def shown(df: DataFrame, x: str) -> DataFrame:
    """A vector as its entries' number, length, and sum weighted by place."""
    weighted = F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return df.select("vec_id", F.size(x).cast("bigint").alias("n"), tidy(S.norm2(x), 4).alias("length"), tidy(weighted, 4).alias("weighted"))


SHOWN = "select vec_id, len(t)::bigint as n, round(sqrt(list_dot_product(t, t)), 4) + 0.0 as length, round(list_sum(list_transform(t, lambda c, i: c * i)), 4) + 0.0 as weighted from t"


@query(f"with recursive {ALL_64}, t as (select vec_id, list_transform(v, lambda c: c * list_dot_product(e.embedding::double[], v)) as t from embeddings e, v3) {SHOWN}")
def pca_project_nth(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return shown(df.withColumn("t", M.pca_project("v", M.pca_basis(df, "v", 3), 2)), "t")


@query(f"""with recursive e as (select vec_id, embedding[1:20]::double[] as u from embeddings), f as (select vec_id, list_concat(u, list_transform(u, lambda c: 1 - c)) as v from e),
    {pca_sql(40, "select v from f", 2)}, t as (select vec_id, list_transform(v2.v, lambda c: c * list_dot_product(f.v, v2.v)) as t from f, v2) {SHOWN}""")
def tailor_inputs(spark, sf_dir):
    return shown(M.tailor_inputs(table(spark, sf_dir, "embeddings"), "embedding", "t", 20, True, 1), "t")


CENTERS = "c as (select vec_id as ord, embedding::double[] as center from embeddings where vec_id < 10)"
PHI = f"with {CENTERS}, f as (select e.vec_id, c.ord, exp(-list_sum(list_transform(list_zip(e.embedding::double[], c.center), lambda z: pow(z[1] - z[2], 2))) / 1.44) as phi from embeddings e, c)"


def centers(df: DataFrame) -> DataFrame:
    return df.where("vec_id < 10").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("center"))


@query(PHI + " select vec_id, count(*) as n, round(sum(phi * (ord + 1)), 6) as weighted from f group by 1")
def rbf_design_matrix(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    rows = M.rbf_design(df, "embedding", centers(df), 1.2)
    return rows.select("vec_id", F.size("phi").cast("bigint").alias("n"), F.round(F.aggregate(F.transform("phi", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("weighted"))


@query(PHI + " select vec_id, round(0.5 + sum(phi * (ord - 4)), 6) + 0.0 as prediction from f group by 1")
def rbf_predict(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return M.rbf_predict(df, "embedding", centers(df), [i - 4.0 for i in range(10)], 0.5, 1.2).select("vec_id", tidy("prediction").alias("prediction"))


#: Normal equations by elimination without exchanges; the least pivot, as a part of what stood there, tells a fit that is none.
READOUT = """with recursive {centers}, f as (select e.vec_id, e.label::double as y, list(exp(-list_sum(list_transform(list_zip(e.embedding::double[], c.center), lambda z: pow(z[1] - z[2], 2))) / 1.44) order by c.ord) as phi from embeddings e, c group by 1, 2),
    h as (select 'full' as fit, vec_id, y, list_append(phi, 1.0) as h from f union all select 'deficient', vec_id, y, list_concat(phi, [phi[1], 1.0]) from f),
    g as (select fit, i, j, sum(h[i] * case when j <= len(h) then h[j] else y end) as c from h, range(1, 13) t(i), range(1, 14) u(j) where i <= len(h) and j <= len(h) + 1 group by 1, 2, 3),
    a0 as (select fit, list(r order by i) as m from (select fit, i, list(c order by j) as r from g group by 1, 2) group by 1),
    a as (select fit, 1 as k, m, m as first, 1.0::double as least from a0
          union all select fit, k + 1, list_transform(range(1, len(m) + 1), lambda i: case when i = k then list_transform(m[k], lambda c: c / m[k][k])
              else list_transform(range(1, len(m) + 2), lambda j: m[i][j] - m[i][k] / m[k][k] * m[k][j]) end), first, least(least, abs(m[k][k]) / first[k][k]) from a where k <= len(m)),
    w as (select fit, least < 1e-9 as bad, list_transform(m, lambda r: r[len(r)]) as w from a where k = len(m) + 1)
    select vec_id, h.fit, round(case when bad then 0 else list_dot_product(h.h, w.w) end, 4) + 0.0 as fitted, bad as degenerate from h join w on h.fit = w.fit"""


@query(READOUT.format(centers=CENTERS))
def least_squares_readout(spark, sf_dir):
    """Two fits: with ten centres, and with one of them twice, which has no single solution."""
    df = table(spark, sf_dir, "embeddings")
    rows, out = M.rbf_design(df, "embedding", centers(df), 1.2), []
    for fit, phi in (("full", F.col("phi")), ("deficient", F.concat("phi", F.slice("phi", 1, 1)))):
        own = rows.withColumn("h", phi)
        w, bias, bad = M.least_squares_readout(own, "h", "label")
        out.append(own.select("vec_id", F.lit(fit).alias("fit"), tidy(S.dot("h", F.array(*[F.lit(v) for v in w])) + bias, 4).alias("fitted"), F.lit(bad).alias("degenerate")))
    return out[0].unionByName(out[1])


@query("select (vec_id % 7)::bigint as mixture, label::bigint as t, sign(avg(x)) as vote from (select vec_id, label, unnest(embedding::double[]) as x from embeddings) group by 1, 2")
def mixture_vote(spark, sf_dir):
    """Every component of a vector is an expert's prediction."""
    df = table(spark, sf_dir, "embeddings")
    return M.mixture_vote(df.select((F.col("vec_id") % 7).alias("mixture"), F.col("label").cast("bigint").alias("t"), F.explode(F.col("embedding").cast("array<double>")).alias("prediction"))).withColumn("vote", F.col("vote").cast("tinyint"))


@query("""with x as (select vec_id, embedding::double[] as v from embeddings), c as (select vec_id as ord, 8 + 4 * (vec_id % 3) as subset, vec_id % 2 = 1 as complement, v from x where vec_id < 10),
    p as (select x.vec_id, ord, complement, x.v[1:subset] as a, c.v[1:subset] as b from x, c), q as (select vec_id, ord, case when complement then list_concat(a, list_transform(a, lambda z: 1 - z)) else a end as a, case when complement then list_concat(b, list_transform(b, lambda z: 1 - z)) else b end as b from p)
    select 'm' || (ord % 2) as mixture, ord as expert, vec_id as t, round(0.1 + 2 * exp(-list_sum(list_transform(list_zip(a, b), lambda z: pow(z[1] - z[2], 2))) / 1.44), 6) as prediction from q""")
def expert_predictions(spark, sf_dir):
    """Ten experts of six kinds of inputs: 8, 12 or 16 features, with or without their complements."""
    df = table(spark, sf_dir, "embeddings")
    genes = df.where("vec_id < 10").withColumns({"subset": (8 + 4 * (F.col("vec_id") % 3)).cast("int"), "complement": F.col("vec_id") % 2 == 1, "component": F.lit(None).cast("int"), "basis": F.lit(None).cast("array<double>")})
    base = F.array(F.struct(M.tailored("embedding").alias("center"), F.lit(2.0).alias("weight")))
    experts = genes.select(F.concat(F.lit("m"), F.col("vec_id") % 2).alias("mixture"), F.col("vec_id").alias("expert"), *M.GENES, F.lit(0.1).alias("bias"), F.lit(1.2).alias("spread"), F.lit(False).alias("degenerate"), base.alias("bases"))
    return M.expert_predictions(df.select(F.col("vec_id").alias("t"), F.col("embedding").alias("features")), experts).withColumn("prediction", F.round("prediction", 6))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = B.bars_orders(spark, sf_dir)
    aligned = A.align_calendar(bars, "1-URGENT", OTHERS).drop("filled").unionByName(bars.where("symbol = '1-URGENT'"))
    return M.feature_matrix(aligned, "1-URGENT", ("2-HIGH", "5-LOW"))


#: The features one by one: averages in compat mode of all series' prices, indicators of one, both scaled to 0..1.
FEATURES = f"""with recursive {ALIGNED}, fb as (select symbol, ts, {', '.join(A.FIELDS)} from al union all select symbol, ts, {', '.join(A.FIELDS)} from bars where symbol = '1-URGENT'),
    fp as (select *, row_number() over ({sql.LINE}) - 1 as pos from fb),
    fl as (select symbol, ts, pos, unnest(['open', 'high', 'low', 'close', 'volume']) as name, unnest([open, high, low, close, volume::double]) as x from fp),
    fs as (select *, first_value(x) over w as fx, sum(case when pos < 10 then x else 0 end) over (partition by symbol, name) as head, sum(x) over (w rows unbounded preceding) as upto, avg(x) over (w rows 9 preceding) as mean
           from fl where name <> 'volume' or symbol = '1-URGENT' window w as (partition by symbol, name order by ts)),
    fm as (select *, case when pos < 10 then (fx + upto) / (pos + 2) else mean + (fx - head / 10) / 11 end as average from fs),
    b0 as (select *, coalesce(close - lag(close) over (order by ts), 0) as move from fp where symbol = '1-URGENT'),
    rr as (select pos, high - low as e, close as f, close as s, 0.0::double as u, 0.0::double as d from b0 where pos = 0
           union all select b.pos, {2 / 11} * (b.high - b.low) + {9 / 11} * r.e, {2 / 11} * b.close + {9 / 11} * r.f, {2 / 22} * b.close + {20 / 22} * r.s, {2 / 11} * greatest(b.move, 0) + {9 / 11} * r.u, {2 / 11} * greatest(-b.move, 0) + {9 / 11} * r.d
           from rr r join b0 b on b.pos = r.pos + 1),
    b1 as (select b0.*, rr.e, rr.f, rr.s, rr.u, rr.d, coalesce(lag(rr.e, 10) over w, first_value(rr.e) over w) as old from b0 join rr on b0.pos = rr.pos window w as (order by b0.ts)),
    b2 as (select *, avg(close) over w2 + regr_slope(close, pos) over w2 * (pos + 1 - avg(pos) over w2) as l2, avg(close) over w7 + regr_slope(close, pos) over w7 * (pos + 1 - avg(pos) over w7) as l7,
           case when pos < 9 or max(close) over w10 = min(close) over w10 then 0 else coalesce(regr_r2(close, pos) over w10, 0) end as r2, case when pos = 0 then close else regr_slope(close, pos) over w4 end as slope,
           case when pos = 0 then 0 else (close - lag(close) over w) / nullif(lag(close) over w, 0) * 100 end as roc, close - coalesce(lag(close, 10) over w, first_value(close) over w) as momentum
           from b1 window w as (order by ts), w2 as (order by ts rows 1 preceding), w4 as (order by ts rows 3 preceding), w7 as (order by ts rows 6 preceding), w10 as (order by ts rows 9 preceding)),
    un as (select symbol, ts, (close - min(close) over s) / nullif(max(close) over s - min(close) over s, 0) as unit from fp window s as (partition by symbol)),
    fv as (select ts, symbol || '.' || name as feature, 'A' as db_group, case when average = 0 then 0 else 100 * (x - average) / average end as value from fm
           union all select ts, '1-URGENT.' || unnest(['roc', 'open_close', 'high_low', 'linreg_gap', 'r_squared', 'slope', 'chaikin', 'macd', 'momentum', 'rsi']), 'B',
               unnest([roc, (open - close) / nullif(open, 0) * 100, (high - low) / nullif(low, 0) * 100, case when pos = 0 then 0 else l2 - l7 end, r2, slope, 100 * (e - old) / nullif(old, 0), f - s, momentum,
                       case when pos = 0 then 50 when d = 0 and u > 0 then 100 else 100 - 100 / (1 + u / nullif(d, 0)) end]) from b2
           union all select ts, 'unit_gap', 'B', sum(case when symbol = '2-HIGH' then unit else -unit end) from un where symbol in ('2-HIGH', '5-LOW') group by 1),
    fz as (select ts, feature, db_group, (value - min(value) over f) / nullif(max(value) over f - min(value) over f, 0) as value from fv window f as (partition by feature))"""


@query(FEATURES + " select ts, feature, db_group, round(value, 6) + 0.0 as value from fz")
def feature_matrix(spark, sf_dir):
    return features(spark, sf_dir).withColumn("value", tidy("value"))


@query(FEATURES + f""", place as (select *, row_number() over (partition by ts order by db_group, feature) as i from fz), lb as (select ts, case when lead(close) over ({sql.LINE}) - close >= 0 then 1 when lead(close) over ({sql.LINE}) - close < 0 then -1 end as label from bars where symbol = '1-URGENT')
    select place.ts, count(*)::int as n, round(sum(coalesce(value, 0) * i), 4) + 0.0 as weighted, any_value(label)::int as label from place join lb on place.ts = lb.ts where label is not null group by 1""")
def training_set(spark, sf_dir):
    labels = halo(orders(spark, sf_dir).where("symbol = '1-URGENT'"), 0, ROWS, lambda d: O.next_close_label(d, "label"), 1)
    weighted = F.aggregate(F.transform("features", lambda x, i: F.coalesce(x, F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return M.training_set(M.to_vectors(features(spark, sf_dir)), labels).select("ts", F.size("features").alias("n"), tidy(weighted, 4).alias("weighted"), "label")


# --- search


@query("with t as (select o_custkey as id, sum(o_totalprice) as quality from orders group by 1), c as (select id, sum(quality) over (order by id rows unbounded preceding) / sum(quality) over () as upto, quality / sum(quality) over () as own from t), k as (select (n_nationkey * 7919 + 13) % 1000 / 1000.0 as u, n_nationkey as pick from nation) select pick, id from k join c on u::double >= upto - own and u::double < upto")
def weighted_pick(spark, sf_dir):
    items = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("quality"))
    picks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("pick"), ((F.col("n_nationkey") * 7919 + 13) % 1000 / 1000.0).alias("u"))
    return G.weighted_pick(items, picks)


PICKS = """u as (select n_nationkey as pair, ('0x' || substr(md5('3:' || n_nationkey), 1, 8))::bigint / 4294967296.0::double as u, ('0x' || substr(md5('4:' || n_nationkey), 1, 8))::bigint / 4294967296.0::double as v from nation),
    c as (select s_suppkey as id, (sum(abs(s_acctbal)) over (order by s_suppkey rows unbounded preceding)) / sum(abs(s_acctbal)) over () as high, abs(s_acctbal) / sum(abs(s_acctbal)) over () as own from supplier where s_acctbal <> 0),
    f as (select u.*, c.id as first, c.high - c.own as low, c.own from u join c on u >= c.high - c.own and u < c.high),
    g as (select *, case when v * (1 - own) >= low then v * (1 - own) + own else v * (1 - own) end as w from f)"""


@query(f"with {PICKS} select pair, first, c.id as second from g join c on w >= c.high - c.own and w < c.high")
def weighted_pick_two(spark, sf_dir):
    items = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.abs("s_acctbal").alias("quality"))
    return G.weighted_pick_two(items, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pair")), 3)


def crossed(rows: DataFrame, vector: Column) -> DataFrame:
    """Each vector's genes crossed with the next one's."""
    genes = rows.select("vec_id", F.posexplode(vector).alias("k", "value"))
    genes = genes.select("vec_id", (F.col("k") + 1).cast("bigint").alias("ord"), F.concat(F.lit("g"), F.col("k") + 1).alias("name"), F.col("value").cast("double").alias("value"))
    coin = (F.col("pair") * 7919 + F.col("ord") * 31 + 13) % 1000 < 500
    return G.crossover(genes.withColumnRenamed("vec_id", "pair"), genes.withColumn("pair", F.col("vec_id") - 1).drop("vec_id"), coin)


@query("select a.vec_id as pair, i as ord, 'g' || i as name, case when (a.vec_id * 7919 + i * 31 + 13) % 1000 < 500 then b.embedding[i]::double else a.embedding[i]::double end as x, case when (a.vec_id * 7919 + i * 31 + 13) % 1000 < 500 then a.embedding[i]::double else b.embedding[i]::double end as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1, (select unnest(range(1, 65)) as i)")
def crossover(spark, sf_dir):
    return crossed(table(spark, sf_dir, "embeddings"), F.col("embedding"))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("double").alias("min"), (F.col("r_regionkey") + 10.0).alias("max"), F.lit(0.25).alias("granularity"))


def drawn(seed: int, *keys: str) -> str:
    """SQL of a draw from 0..1."""
    return f"(('0x' || substr(md5('{seed}:' || {' || chr(58) || '.join(keys)}), 1, 8))::bigint / 4294967296.0::double)"


GENES = f"""s as (select r_name as name, r_regionkey::double as low, r_regionkey + 10.0::double as high from region), n as (select unnest(range(0, (select count(*) from customer))) as candidate),
    genes as (select candidate, name, low, high, least(high, round_even({drawn(5, 'candidate', 'name')} * (high - low) / 0.25, 0) * 0.25 + low) as value from n, s)"""


@query(f"with {GENES} select candidate, name, value from genes")
def random_candidates(spark, sf_dir):
    n = table(spark, sf_dir, "customer").count()
    return G.random_candidates(spark, n, specs(spark, sf_dir), 5)


@query("select c_custkey, round(" + drawn(21, "c_custkey") + " * 30 + 20, 6) as u, " + drawn(22, "c_custkey") + " < 0.3 as coin, round((" + " + ".join(drawn(23 * 65536 + i, "c_custkey") for i in range(4)) + ") * 2 - 4, 6) + 0.0 as total from customer")
def uniform_double(spark, sf_dir):
    """uniform_double, with_prob and random_vector: draws that depend on the row's key."""
    v = F.aggregate(S.random_vector(23, 4, -1.0, 1.0, "c_custkey"), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(S.uniform(21, 20.0, 50.0, "c_custkey"), 6).alias("u"), S.with_prob(22, 0.3, "c_custkey").alias("coin"), tidy(v).alias("total"))


@query(f"with {O_}, m as (pivot (select symbol, ts, close from bars) on symbol in ({FIVE}) using max(close) group by ts) select ts, round(" + " + ".join(f'coalesce(\"{s}\", 0) * {i + 1}' for i, s in enumerate(["1-URGENT", *OTHERS])) + ", 4) as weighted from m")
def columns_to_matrix(spark, sf_dir):
    """Closes of five series as rows of a matrix, by date; null where a series has no bar."""
    rows = M.columns_to_matrix(B.bars_orders(spark, sf_dir).select("ts", F.col("symbol").alias("feature"), F.col("close").alias("value")), ["1-URGENT", *OTHERS])
    total = F.aggregate(F.transform("values", lambda x, i: F.coalesce(x, F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("ts", F.round(total, 4).alias("weighted"))


@query(f"with {GENES} select candidate, name, case when {drawn(9, 'candidate', 'name')} < 0.05 then least(high, round_even({drawn(10, 'candidate', 'name')} * (high - low) / 0.25, 0) * 0.25 + low) else value end as value from genes")
def mutate(spark, sf_dir):
    n = table(spark, sf_dir, "customer").count()
    return G.mutate(G.random_candidates(spark, n, specs(spark, sf_dir), 5), specs(spark, sf_dir), 0.05, 9)


def evolved(generations: int, seed: int) -> str:
    """SQL of a genetic search: each generation's fitness, parents, couples and children, who mutate into the next."""
    redrawn = lambda n: f"least(high, round_even({drawn(n, 'candidate', 'name')} * (high - low) / 0.25, 0) * 0.25 + low)"
    parts = [
        "size as (select count(*) as n from supplier)",
        "spec as (select r_name as name, r_regionkey::double as low, r_regionkey + 10.0::double as high from region)",
        f"g0 as materialized (select candidate, name, {redrawn(seed)} as value from (select unnest(range(n)) as candidate from size), spec)",
    ]
    for g in range(generations):
        at = seed + 10 * g
        parts.append(f"s{g} as materialized (select candidate, 1 / (1 + sum(abs(value - 5))) as fitness from g{g} group by 1)")
        if g + 1 == generations:
            break
        parts += [
            f"p{g} as (select candidate as id, fitness as q from s{g} qualify row_number() over (order by fitness desc, candidate) <= (select greatest(2, n // 4) from size))",
            f"c{g} as materialized (select id, sum(q) over (order by id rows unbounded preceding) / sum(q) over () as upto, q / sum(q) over () as own from p{g})",
            f"u{g} as (select pair, {drawn(at + 1, 'pair')} as u, {drawn(at + 2, 'pair')} as v from (select unnest(range((n + 1) // 2)) as pair from size))",
            f"f{g} as (select u{g}.*, id as first, upto - own as low, own, v * (1 - own) as rest from u{g} join c{g} on u >= upto - own and u < upto)",
            f"t{g} as materialized (select pair, first, c.id as second from (select *, case when rest >= low then rest + own else rest end as w from f{g}) f join c{g} c on w >= c.upto - c.own and w < c.upto)",
            f"x{g} as (select pair, a.name, a.value as x, b.value as y, {drawn(at + 2, 'pair', '0', 'a.name')} < 0.5 as swap from t{g} join g{g} a on a.candidate = first join g{g} b on b.candidate = second and b.name = a.name)",
            f"k{g} as (select 2 * pair as candidate, name, case when swap then y else x end as value from x{g} union all select 2 * pair + 1, name, case when swap then x else y end from x{g})",
            f"g{g + 1} as materialized (select candidate, name, case when {drawn(at + 3, 'candidate', 'name')} < 0.05 then {redrawn(at + 4)} else value end as value from k{g} join spec using (name) where candidate < (select n from size))",
        ]
    return f"with {', '.join(parts)} " + " union all ".join(f"select {g} as generation, candidate, fitness from s{g}" for g in range(generations))


@query(evolved(3, 11))
def evolve(spark, sf_dir):
    """Three generations of candidates, fitter the nearer their genes are to 5."""
    evaluate = lambda genes: genes.groupBy("candidate").agg((1 / (1 + F.sum(F.abs(F.col("value") - 5)))).alias("fitness"))
    n = table(spark, sf_dir, "supplier").count()
    return G.evolve(spark, specs(spark, sf_dir), evaluate, n, max(2, n // 4), 3, 0.05, 11)


@query(f"with {O_}, {P}, g as (select unnest(range(2, 7))::double as n), k as (select g.n, p.symbol, p.ts, close - lag(close, 2) over (partition by g.n, p.symbol order by ts) * (n / 4) as sig, lead(close) over (partition by g.n, p.symbol order by ts) - close as d from p, g) select n, count(*) as bars, round(avg(case when sign(sig) = sign(d) then 1.0 else 0.0 end), 6) as fitness from k where sig is not null and d is not null group by 1")
def grid_search(spark, sf_dir):
    def around(df: DataFrame) -> DataFrame:
        return df.withColumn("old", W.lagged("close", 2)).withColumn("d", F.lead("close").over(W.line()) - F.col("close"))

    def kernel(df: DataFrame) -> DataFrame:
        df = df.withColumn("sig", F.col("close") - F.col("old") * (F.col("n") / 4))
        same = F.when(F.signum("sig") == F.signum("d"), 1.0).otherwise(0.0)
        return df.where("sig is not null and d is not null").groupBy("n").agg(F.count(F.lit(1)).alias("bars"), F.round(F.avg(same), 6).alias("fitness"))

    return G.grid_search(orders(spark, sf_dir), G.param_grid(spark, {"n": (2.0, 6.0, 1.0)}), kernel, around, 2, 1)


#: Each candidate's slice of the rows, its centres, and its normal equations by elimination, scored on all rows.
TRAINED = """with recursive x as (select embedding::double[] as x, case when label % 2 <> 0 then 1.0 else -1.0 end as y, row_number() over (order by vec_id) - 1 as pos, count(*) over () as n from embeddings),
    c0 as (select s_suppkey as candidate, (s_suppkey % 10 / 20)::double as off, (s_suppkey % 3 + 1)::double as spread, (select max(n) from x) as n from supplier),
    c1 as (select *, greatest(0, least(n - 1, floor(off * n)))::bigint as first from c0), c2 as (select *, greatest(1, least(n - first, floor(0.4::double * n)))::bigint as size from c1),
    k as (select candidate, spread, first, first + size as stop, ord, first + ord * greatest(1, size // 8) as pos from c2, range(0, 8) r(ord) where ord * greatest(1, size // 8) < size),
    h as (select k.candidate, x.pos, x.y, x.pos >= any_value(k.first) and x.pos < any_value(k.stop) as own, list_append(list(exp(-list_sum(list_transform(list_zip(x.x, c.x), lambda z: pow(z[1] - z[2], 2))) / pow(k.spread, 2)) order by k.ord), 1.0) as h
          from k join x c on c.pos = k.pos, x group by 1, 2, 3),
    g as (select candidate, i, j, sum(h[i] * case when j <= len(h) then h[j] else y end) as c from h, range(1, 10) t(i), range(1, 11) u(j) where own and i <= len(h) and j <= len(h) + 1 group by 1, 2, 3),
    a0 as (select candidate, list(r order by i) as m from (select candidate, i, list(c order by j) as r from g group by 1, 2) group by 1),
    a as (select candidate, 1 as k, m from a0 union all select candidate, k + 1, list_transform(range(1, len(m) + 1), lambda i: case when i = k then list_transform(m[k], lambda c: c / m[k][k])
              else list_transform(range(1, len(m) + 2), lambda j: m[i][j] - m[i][k] / m[k][k] * m[k][j]) end) from a where k <= len(m)),
    w as (select candidate, list_transform(m, lambda r: r[len(r)]) as w from a where k = len(m) + 1)
    select h.candidate, round(avg(case when sign(list_dot_product(h.h, w.w)) = sign(h.y) then 1.0 else 0.0 end), 4) as fitness from h join w on h.candidate = w.candidate group by 1"""


@query(TRAINED)
def candidate_training(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.when(F.col("label") % 2 != 0, 1.0).otherwise(-1.0).alias("y"))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("candidate"), (F.col("s_suppkey") % 10 / 20).alias("offset"), F.lit(0.4).alias("size"), (F.col("s_suppkey") % 3 + 1.0).alias("spread"))
    fitted = G.written(M.train_candidates(own, rows.withColumnRenamed("vec_id", "row")))
    return M.candidate_fitness(rows, fitted).select("candidate", F.round("fitness", 4).alias("fitness"))


#: The same by candidates on inputs of their own genes; complement coding doubles a squared distance.
TAILORED = (
    TRAINED.replace("(s_suppkey % 3 + 1)::double as spread", "((s_suppkey % 3 + 1) / 2)::double as spread, 16 * (s_suppkey % 4 + 1) as subset, s_suppkey % 2 + 1 as twice")
    .replace("select candidate, spread, first", "select candidate, spread, subset, twice, first")
    .replace("-list_sum(list_transform(list_zip(x.x, c.x)", "-twice * list_sum(list_transform(list_zip(x.x[1:subset], c.x[1:subset])")
)


@query(TAILORED)
def tailored_training(spark, sf_dir):
    """Candidates with genes: the first 16, 32, 48 or 64 features, every other one complement coded."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.when(F.col("label") % 2 != 0, 1.0).otherwise(-1.0).alias("y"))
    key = F.col("s_suppkey")
    own = table(spark, sf_dir, "supplier").select(key.alias("candidate"), (key % 10 / 20).alias("offset"), F.lit(0.4).alias("size"), ((key % 3 + 1.0) / 2).alias("spread"), (16 * (key % 4 + 1)).alias("subset"), (key % 2 == 1).alias("complement"))
    fitted = G.written(M.train_candidates(own, rows.withColumnRenamed("vec_id", "row")))
    return M.candidate_fitness(rows, fitted).join(fitted.where("seconds > 0").select("candidate"), "candidate").select("candidate", F.round("fitness", 4).alias("fitness"))


# --- views


@query(f"with {EVALS}, g as (select run_id, generation, max(fitness) as f from ev group by 1, 2) select n_nationkey as run_id, n_name, count(*) as generations, string_agg(generation || ':' || format('{{:.2f}}', f), ',' order by generation) as fitness from nation join g on run_id = n_nationkey group by 1, 2")
def view_runs(spark, sf_dir):
    ev = evals(spark, sf_dir)
    runs = V.view_runs(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run_id"), "n_name"), ev.select("run_id", "generation").distinct(), ev)
    text = F.array_join(F.transform("generations", lambda g: F.concat(g["generation"], F.lit(":"), F.format_string("%.2f", g["fitness"]))), ",")
    return runs.select("run_id", "n_name", F.size("generations").cast("bigint").alias("generations"), text.alias("fitness"))


@query(f"with {EVALS} select distinct run_id from ev")
def view_run_ids(spark, sf_dir):
    return evals(spark, sf_dir).select("run_id").distinct()


@query(f"with {EVALS} select run_id, generation, max(fitness) as fitness from ev where run_id = 7 group by 1, 2")
def view_run(spark, sf_dir):
    return V.fitness_series(evals(spark, sf_dir).where("run_id = 7"))


@query("select r_regionkey, r_name from region")
def view_protoruns(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", "r_name")


@query(f"with {EVALS} select run_id, generation, max(fitness) as fitness from ev group by 1, 2 order by 1, 2")
def view_fitness_series(spark, sf_dir):
    return V.fitness_series(evals(spark, sf_dir)).orderBy("run_id", "generation")


@query(f"with {O_} select * from bars where symbol = '3-MEDIUM' order by ts")
def view_bars(spark, sf_dir):
    return B.bars_orders(spark, sf_dir).where("symbol = '3-MEDIUM'").orderBy("ts")


@query(f"with {O_} select * from bars where symbol = '3-MEDIUM' and ts between '1997-01-01' and '1997-12-31' order by ts")
def view_bars_range(spark, sf_dir):
    return B.universe(B.bars_orders(spark, sf_dir), ["3-MEDIUM"], "1997-01-01", "1997-12-31").orderBy("ts")


@query(f"with {EVALS} select run_id, mixture_id, fitness from ev where generation = 1997")
def view_generation(spark, sf_dir):
    return evals(spark, sf_dir).where("generation = 1997").select("run_id", "mixture_id", "fitness")


@query("select n_nationkey as mixture_id, count(*) as experts, string_agg(s_suppkey || case when s_suppkey % 2 = 0 then ':rbf:' || (s_suppkey % 3 + 1) else ':recurrent:' || (s_suppkey % 50 + 1) end, ',' order by s_suppkey) as ids from nation join supplier on s_nationkey = n_nationkey group by 1")
def view_mixture_tree(spark, sf_dir):
    """Mixtures of experts of two kinds, every other one, each kind with a field of its own."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("mixture_id"), F.col("s_suppkey").cast("bigint").alias("ord"))
    rbf = own.where("ord % 2 = 0").withColumns({"kind": F.lit("rbf"), "spread": F.col("ord") % 3 + 1})
    recurrent = own.where("ord % 2 <> 0").withColumns({"kind": F.lit("recurrent"), "epochs": F.col("ord") % 50 + 1})
    tree = V.mixture_tree(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("mixture_id")), rbf, recurrent)
    text = lambda e: F.concat_ws(":", e["ord"].cast("string"), e["kind"], F.coalesce(e["spread"], e["epochs"]).cast("string"))
    return tree.select("mixture_id", F.size("experts").cast("bigint").alias("experts"), F.array_join(F.transform("experts", text), ",").alias("ids"))


@query(f"with {O_} select row_number() over (order by symbol) as run_id, 'run ' || row_number() over (order by symbol) || ' on ' || symbol || ': ' || count(*) || ' bars from ' || strftime(min(ts), '%Y-%m-%d') as description from bars group by symbol")
def run_description(spark, sf_dir):
    runs = B.bars_orders(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))  # a row a run
    return V.run_description(runs.withColumn("run_id", F.row_number().over(W.Window.orderBy("symbol")).cast("bigint")))


# --- scale paths


@query(f"with {E}, {P} select symbol, ts, pos from p")
def two_level_pos_(spark, sf_dir):
    return two_level_pos(B.bars_events(spark, sf_dir), F.to_date("ts")).select("symbol", "ts", "pos")


@query(sql.series("avg(close) over wp"))
def halo_sma(spark, sf_dir):
    df = halo(events(spark, sf_dir), 9, 64, lambda d: O.sma(d, "close", 10, "value"))
    return df.select("symbol", "ts", tidy("value").alias("value"))


@query(f"with {E}, {P} select symbol, ts, round(close - coalesce(lag(close, 3) over w, first_value(close) over w), 6) + 0.0 as value from p window w as ({sql.LINE})")
def udf_indicator(spark, sf_dir):
    return halo(events(spark, sf_dir), 3, ROWS, lambda d: O.momentum(d, "close", 3, "value")).select("symbol", "ts", tidy("value").alias("value"))
