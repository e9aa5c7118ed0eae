"""Bars (symbol, ts, open, high, low, close, volume) from ticks, text files, HTML pages and JSON."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint"


def ticks_to_bars(ticks: DataFrame, symbol: str, ts: str, tie: list[str], price: str, unit: str) -> DataFrame:
    """One bar a symbol and time unit; first and last price by (ts, tie). All aggregates combine before the shuffle."""
    at = F.struct(F.col(ts), *[F.col(c) for c in tie])
    grouped = ticks.groupBy(F.col(symbol).alias("symbol"), F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("ts"))
    p = F.col(price).cast("double")
    return grouped.agg(
        F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"), F.count(F.lit(1)).alias("volume")
    )


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", ["event_id"], "value", "hour")


def bars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderdate", ["o_orderkey"], "o_totalprice", "day")


def bars_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return ticks_to_bars(lines, "l_returnflag", "l_shipdate", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "l_extendedprice", "day")


def bars_text(bars: DataFrame) -> DataFrame:
    """Bars as lines of the text layout, with their symbol."""
    price = lambda c: F.format_string("%.6f", F.col(c))
    line = F.concat_ws(";", F.date_format("ts", "yyyyMMdd"), price("open"), price("high"), price("low"), price("close"), F.col("volume").cast("string"))
    return bars.select("symbol", line.alias("line"))


def write_bars(bars: DataFrame, path: str) -> None:
    """Text files by symbol (symbol=... folders)."""
    columns = [F.date_format("ts", "yyyyMMdd").alias("day"), "open", "high", "low", "close", "volume", "symbol"]
    bars.select(*columns).write.partitionBy("symbol").option("sep", ";").csv(path)


def normalize_vendor_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Vendor CSV with a header and descending `yyyy-MM-dd` dates; order is by ts, not by place in the file."""
    rows = spark.read.schema("Date string, Open double, High double, Low double, Close double, Volume bigint").option("header", True).csv(path)
    return rows.select(F.lit(symbol).alias("symbol"), F.to_timestamp("Date", "yyyy-MM-dd").cast("timestamp_ntz").alias("ts"), *[F.col(c.title()).alias(c) for c in ("open", "high", "low", "close", "volume")])


def html_cells(html: Column, tag: str = "td") -> Column:
    """Texts of a tag's elements, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))


def extract_price_tables(pages: DataFrame, start: str) -> DataFrame:
    """Rows of seven cells - date, open, high, low, close, volume, adjusted close - from start on. pages: (page_id, html)."""
    rows = pages.select("page_id", F.explode(html_cells(F.col("html"), "tr")).alias("row")).withColumn("c", html_cells(F.col("row")))
    number = lambda i, kind: F.expr(f"try_cast(replace(trim(c[{i}]), ',', '') as {kind})")
    rows = rows.where("size(c) = 7").select("page_id", F.expr("try_to_timestamp(trim(c[0]), 'MMM d, yyyy')").cast("timestamp_ntz").alias("ts"), *[number(i + 1, "double").alias(c) for i, c in enumerate(("open", "high", "low", "close"))], number(5, "bigint").alias("volume"))
    return rows.where((F.col("ts") >= F.to_timestamp(F.lit(start)).cast("timestamp_ntz")) & F.col("close").isNotNull())


def next_link(html: Column, label: str = "Next") -> Column:
    """Target of the link with a label, HTML-decoded; null if there is none."""
    found = F.regexp_extract(html, rf'(?is)<a\b[^>]*href="([^"]*)"[^>]*>\s*{label}\s*</a>', 1)
    return F.when(found != "", F.replace(found, F.lit("&amp;"), F.lit("&")))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, n_links, first_link, next_link) of pages (page_id, html)."""
    links = F.regexp_extract_all(F.col("html"), F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.size(links).cast("bigint").alias("n_links"), F.replace(F.get(links, F.lit(0)), F.lit("&amp;"), F.lit("&")).alias("first_link"), next_link(F.col("html")).alias("next_link"))


def read_trade_log(lines: DataFrame) -> DataFrame:
    """`M/d/yyyy gain [shares] [profit]` lines (column value); blank ones and those without a date are left out."""
    c = F.split(F.trim("value"), r"\s+")
    day = F.try_to_timestamp(F.get(c, F.lit(0)), F.lit("M/d/yyyy")).cast("timestamp_ntz")
    number = lambda i: F.get(c, F.lit(i)).try_cast("double")
    return lines.select(day.alias("ts"), number(1).alias("gain"), number(2).cast("bigint").alias("shares"), number(3).alias("profit")).where("ts is not null and gain is not null")


def read_search_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report logs: one row a block, (fitness, params map) from its `name: value` lines."""
    blocks = spark.read.option("lineSep", "=== BEST ===").text(path)
    pairs = F.filter(F.transform(F.split("value", "\n"), lambda x: F.regexp_extract_all(x, F.lit(r"^\s*([^:]+?)\s*:\s*(.*?)\s*$"), F.lit(0))), lambda x: F.size(x) > 0)
    named = F.transform(pairs, lambda x: F.struct(F.trim(F.split_part(x[0], F.lit(":"), F.lit(1))).alias("key"), F.trim(F.substring_index(x[0], ":", -1)).alias("value")))
    rows = blocks.select(F.map_from_entries(F.array_distinct(named)).alias("params"))
    return rows.where(F.map_contains_key("params", "Fitness")).select(F.col("params")["Strategy"].alias("strategy"), F.col("params")["Fitness"].try_cast("double").alias("fitness"), "params")


def read_run_requests(spark: SparkSession, path: str, a_line: bool = False) -> DataFrame:
    """Run requests, one a file (or a line), whose dates are ISODate("...") literals."""
    schema = "Type string, ProtoRunName string, Symbol string, StartDate string, EndDate string, ValidationPct double, SignalType string"
    text = spark.read.text(path, wholetext=not a_line)
    return text.select(F.from_json(F.regexp_replace("value", r'ISODate\(\s*("[^"]*")\s*\)', "$1"), schema).alias("r")).select("r.*")


def read_settings_xml(spark: SparkSession, path: str) -> DataFrame:
    """Genes (Name, Min, Max, Granularity, Value) of settings files."""
    schema = "Name string, Min double, Max double, Granularity double, Value double"
    return spark.read.format("xml").option("rowTag", "VGene").schema(schema).load(path)


#: Record types by the Type they name.
MESSAGES = {"props": "struct<k:bigint>", "order": "struct<id:bigint,price:double>", "customer": "struct<id:bigint,segment:string>"}


def decode_typed_json(rows: DataFrame, text: str, types: dict[str, str], default: str | None = None) -> DataFrame:
    """Adds route (the Type that matched, or `unknown`) and one struct column for each type; the text stays for dead letters.

    types: Type value -> schema of its record. default: the type of objects that name none.
    """
    kind = F.coalesce(F.get_json_object(F.col(text), "$.Type"), F.lit(default))
    out = rows
    for name, schema in types.items():
        out = out.withColumn(name, F.when(kind == name, F.from_json(F.col(text), schema)))
    route = F.coalesce(*[F.when(F.col(n).isNotNull() & F.exists(F.array(*[F.col(f"{n}.{f.split(':')[0].strip()}").isNotNull() for f in s.removeprefix("struct<").removesuffix(">").split(",")]), lambda x: x), n) for n, s in types.items()], F.lit("unknown"))
    return out.withColumn("route", route)


class Handler(NamedTuple):
    """Takes messages of one Type: their record's schema, the fields it can't do without, and a condition on the record `r`."""

    route: str
    kind: str
    schema: str
    needs: tuple[str, ...] = ()
    where: str = "true"


#: One handler for each of the record types above.
HANDLERS = [Handler("props", "props", MESSAGES["props"], ("k",)), Handler("order", "order", MESSAGES["order"], ("id", "price")), Handler("customer", "customer", MESSAGES["customer"], ("id",))]


def dispatched(rows: DataFrame, text: str, handlers: list[Handler], default: str | None = None) -> DataFrame:
    """Adds route, one record column for each handler's route, and error.

    Handlers are asked in order and the first that takes the message has it; what none takes goes to `unknown` with the
    reason: no JSON, no type, no handler of its type, or what the last handler of its type missed. default: the type of
    objects that name none.
    """
    named = F.get_json_object(F.col(text), "$.Type")
    whole = F.get_json_object(F.col(text), "$").startswith("{")
    kind = F.when(whole, F.coalesce(named, F.lit(default)))
    missed = F.when(~F.coalesce(whole, F.lit(False)), F.lit("no JSON object")).when(kind.isNull(), F.lit("no type"))
    missed = missed.when(~kind.isin([h.kind for h in handlers]), F.concat(F.lit("no handler for "), kind))
    out = rows.withColumn("_kind", kind)
    for i, h in enumerate(handlers):
        out = out.withColumn("r", F.when(F.col("_kind") == h.kind, F.from_json(F.col(text), h.schema)))
        lacks = F.array_join(F.filter(F.array(*[F.when(F.col(f"r.{n}").isNull(), F.lit(n)) for n in h.needs], F.lit(None).cast("string")), lambda x: x.isNotNull()), ", ")
        own = F.when(lacks != "", F.concat(F.lit(f"{h.kind}: lacks "), lacks)).when(~F.coalesce(F.expr(h.where), F.lit(False)), F.lit(f"{h.kind}: {h.route} refuses it"))
        out = out.withColumn(f"_e{i}", F.when(F.col("_kind") == h.kind, own)).withColumn(f"_r{i}", F.when((F.col("_kind") == h.kind) & F.col(f"_e{i}").isNull(), F.col("r"))).drop("r")
    route = F.coalesce(*[F.when(F.col(f"_r{i}").isNotNull(), h.route) for i, h in enumerate(handlers)], F.lit("unknown"))
    last = F.coalesce(*[F.col(f"_e{i}") for i in reversed(range(len(handlers)))])
    out = out.withColumn("route", route).withColumn("error", F.when(F.col("route") == "unknown", F.coalesce(missed, last)))
    records: dict[str, Column] = {}
    for i, h in enumerate(handlers):
        own = F.when((F.col("route") == h.route), F.col(f"_r{i}"))
        records[h.route] = F.coalesce(records[h.route], own) if h.route in records else own
    return out.withColumns(records).drop("_kind", *[f"_{x}{i}" for x in "er" for i in range(len(handlers))])


def universe(bars: DataFrame, symbols: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of some symbols, dates inclusive; filters reach the scan where bars is a table partitioned by symbol."""
    rows = bars.where(F.col("symbol").isin(symbols))
    rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz")) if start else rows
    return rows.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz")) if end else rows


def exactly_one(rows: DataFrame, condition: Column) -> DataFrame:
    """The one row with a condition; the query fails if there are none or more."""
    found = rows.where(condition).limit(2)
    n = F.count(F.lit(1))
    return found.agg(F.first(F.struct("*")).alias("row"), F.assert_true(n == 1, "exactly one row is asked for").alias("_")).where("_ is null").select("row.*")


def newer_than_stored(incoming: DataFrame, stored: DataFrame, default: str = "2001-11-10", per_symbol: bool = False) -> DataFrame:
    """Rows a day or more after the last stored one: of all symbols, or of the row's own symbol."""
    start = F.lit(default).cast("timestamp_ntz")
    day = F.expr("interval 1 day")
    if per_symbol:
        marks = stored.groupBy("symbol").agg(F.max("ts").alias("_mark"))
        rows = incoming.join(marks, "symbol", "left")
    else:
        rows = incoming.crossJoin(F.broadcast(stored.agg(F.max("ts").alias("_mark"))))  # one row
    return rows.where(F.col("ts") >= F.coalesce(F.col("_mark") + day, start)).drop("_mark")
