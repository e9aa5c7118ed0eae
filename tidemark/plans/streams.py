"""Registered streaming queries: the driver tables replayed to their end, and the batch SQL their results equal."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import frames as W
from tidemark.functions import scalar as S
from tidemark.operators import history as H
from tidemark.plans import queries as Q
from tidemark.plans import sql
from tidemark.plans.indicators import tidy
from tidemark.sources.bars import HANDLERS, MESSAGES, bars_events
from tidemark.sources.bars import read_run_requests as parse
from tidemark.sources.bars import read_settings_xml as read
from tidemark.sources.sinks import store_read
from tidemark.streaming import ops

QUERIES, SQL = {}, {}


def query(text: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return keep


def replay(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; timestamps without a zone become timestamps."""
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    schema = table.schema
    stream = spark.readStream.schema(schema)
    if table.inputFiles()[0].endswith(f"/{name}.parquet"):  # one file: a stream reads its folder
        rows = stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    else:
        rows = stream.parquet(path)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def finished(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a stream over all there is, in append mode, and read what it wrote."""
    path = Q.scratch(spark, "stream")
    run = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    run.format("parquet").option("path", path).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(f"with {sql.EVENTS} select symbol, ts, open, high, low, close, volume from bars where ts + interval 1 hour <= (select max(ts) from events) - interval 2 hour")
def stream_bars(spark, sf_dir):
    bars = finished(ops.stream_bars(replay(spark, sf_dir, "events"), "event_type", "value", "event_id"), spark)
    return bars.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("select distinct o_orderpriority as symbol, o_orderdate::timestamp as ts from orders where o_orderdate > '2000-01-01'")
def stream_ingest_new(spark, sf_dir):
    rows = replay(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return finished(ops.ingest_new(rows, "2000-01-01"), spark).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"with m as ({Q.SENT_SQL}) select *, case when route <> 'unknown' then null when origin = 'event' then 'props: lacks k' else 'no handler for ' || origin end as error from m")
def stream_decode_route(spark, sf_dir):
    """Streams of four types of messages, dispatched to three typed stores and one of dead letters, which are then read."""
    path = Q.scratch(spark, "routes")
    sent = Q.messages(lambda name: replay(spark, sf_dir, name))
    ops.route(sent, "text", HANDLERS, path, f"{path}-state", "props").trigger(availableNow=True).start().awaitTermination()
    value = {"props": F.col("r.k").cast("double"), "order": F.col("r.price"), "customer": F.length("r.segment").cast("double")}
    stores = [store_read(spark, f"{path}/{n}", T.StructType.fromDDL(f"origin string, id bigint, {n} {MESSAGES[n]}")).withColumnRenamed(n, "r").select("origin", "id", F.lit(n).alias("route"), v.alias("value"), F.lit(None).cast("string").alias("error")) for n, v in value.items()]
    dead = store_read(spark, f"{path}/unknown", T.StructType.fromDDL("origin string, id bigint, text string, error string")).select("origin", "id", F.lit("unknown").alias("route"), F.lit(None).cast("double").alias("value"), "error")
    return functools.reduce(DataFrame.unionByName, [*stores, dead])


@query("select count(distinct (user_id, event_id)) as completed, round(count(distinct (user_id, event_id)) / (count(*) + count(distinct user_id)), 6) as share from events")
def stream_progress(spark, sf_dir):
    """Every event is an item of its user's, and is delivered twice; each user has asked for one item more than was done."""
    asked = Q.table(spark, sf_dir, "events").agg((F.count(F.lit(1)) + F.countDistinct("user_id")).alias("n")).first()["n"]
    notes = replay(spark, sf_dir, "events").select("ts", F.col("user_id").alias("mixture"), F.col("event_id").alias("ord"))
    notes = notes.withColumn("delivery", F.explode(F.sequence(F.lit(1), F.lit(2)))).drop("delivery")
    path = Q.scratch(spark, "progress")
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(path)
    ops.stream_progress(notes, asked).writeStream.outputMode("complete").option("checkpointLocation", f"{path}-state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("completed bigint, share double").parquet(path).select("completed", F.round("share", 6).alias("share"))


TICKS = "k as (select event_type as symbol, ts::timestamp as ts, value::double as x, row_number() over (partition by event_type order by ts) - 1 as pos from events)"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("id"), F.col("value").cast("double").alias("x"))


def values(spark: SparkSession, sf_dir: str, stream: Callable[..., DataFrame], p: int) -> DataFrame:
    """A series operator run over all there is, which comes as one batch, so no row is late."""
    rows = finished(stream(ticks(spark, sf_dir), p), spark)
    return rows.where("not late").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), tidy("value").alias("value"))


@query(f"with {TICKS} select symbol, ts, round(avg(x) over (partition by symbol order by ts rows 6 preceding), 6) + 0.0 as value from k")
def stream_mean(spark, sf_dir):
    return values(spark, sf_dir, ops.stream_mean, 7)


@query(f"with {TICKS} select symbol, ts, round(stddev_pop(x) over (partition by symbol order by ts rows 6 preceding), 6) + 0.0 as value from k")
def stream_std(spark, sf_dir):
    return values(spark, sf_dir, ops.stream_std, 7)


@query(f"with recursive {TICKS}, r as (select symbol, ts, pos, x as v from k where pos = 0 union all select b.symbol, b.ts, b.pos, {2 / 11} * b.x + {9 / 11} * r.v from r join k b on b.symbol = r.symbol and b.pos = r.pos + 1) select symbol, ts, round(v, 6) + 0.0 as value from r")
def stream_ema(spark, sf_dir):
    return values(spark, sf_dir, ops.stream_ema, 10)


@query()
def stream_ledger(spark, sf_dir):
    path = Q.scratch(spark, "orders")
    Q.ledger_orders(spark, sf_dir).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    rows = finished(ops.stream_ledger(stream, 1e6, 4.0, 3.0), spark)
    return rows.groupBy("account").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {sql.EVENTS} select symbol, ts, round(max(close) over (partition by symbol order by ts rows unbounded preceding) - close, 6) + 0.0 as value from bars")
def map_with_history(spark, sf_dir):
    step = lambda state, x: (max(state, x), max(state, x) - x)
    return H.map_with_history(bars_events(spark, sf_dir), ["close"], lambda: float("-inf"), step, "value").withColumn("value", tidy("value"))


@query(f"with {sql.EVENTS}, f as (select symbol, ts, max(close) over w - close as fall from bars window w as ({sql.LINE} rows unbounded preceding)) select symbol, ts, round(max(fall) over ({sql.LINE} rows unbounded preceding), 6) + 0.0 as value from f")
def udf_map_series(spark, sf_dir):
    """The largest fall from an earlier close to a later one so far: state is (highest, lowest, largest fall), in blocks of 64 bars."""
    begin = lambda: [None, None, 0.0]

    def merge(a: list, b: list) -> list:
        if a[0] is None or b[0] is None:
            return b if a[0] is None else a
        return [max(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2], a[0] - b[1])]

    bars = W.with_pos(bars_events(spark, sf_dir))
    rows = H.map_blocks(bars, ["close"], begin, lambda s, x: merge(s, [x, x, 0.0]), merge, lambda s, x: s[2], "value", 64)
    return rows.withColumn("value", tidy("value"))


@query(f"with {sql.EVENTS}, e as (select symbol, ts, list(close) over ({sql.LINE} rows between (volume % 7) preceding and current row) as l from bars) select symbol, ts, len(l)::bigint as n, round(list_sum(list_transform(l, lambda x, i: x * i)), 6) + 0.0 as weighted_sum from e")
def udtf_examples(spark, sf_dir):
    """Windows of closes, each as long as its own bar's volume says: 1 to 7 bars."""
    rows = H.sized_examples(W.with_pos(bars_events(spark, sf_dir)), "close", F.col("volume") % 7 + 1, 7)
    total = F.aggregate(F.transform("example", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return rows.select("symbol", "ts", F.size("example").cast("bigint").alias("n"), tidy(total).alias("weighted_sum"))


@query(f"with {sql.EVENTS} select symbol, ts, round(high * 2 - low, 6) + 0.0 as value from bars")
def udf_zip_series(spark, sf_dir):
    df = bars_events(spark, sf_dir)
    return H.zip_with(df, df, "high", "low", lambda x, y: tidy(x * 2 - y), "value")


@query(sql.series("-(close - coalesce(lag(close, 6) over w, first_value(close) over w))"))
def udf_strategy(spark, sf_dir):
    rows = H.make_signal("contrarian", period=6)(W.with_pos(bars_events(spark, sf_dir)))
    return rows.select("symbol", "ts", tidy("signal").alias("value"))


@query(f"with {sql.EVENTS}, {sql.POS}, g as (select unnest([2, 5, 10]) as period), m as (select g.period, symbol, close - coalesce(lag(close, 1) over w, close) as m, close >= open as up from p, g window w as (partition by g.period, symbol order by ts)) select period, round(avg(case when (m * period >= 0) = up then 1.0 else 0.0 end), 6) as fitness from m group by 1")
def udf_kernel(spark, sf_dir):
    def moved(df: DataFrame) -> DataFrame:
        return df.withColumn("m", F.col("close") - F.coalesce(W.lagged("close", 1), F.col("close")))

    def kernel(df: DataFrame) -> DataFrame:
        rows = df.withColumn("hit", F.when((F.col("m") * F.col("period") >= 0) == S.is_green(), 1.0).otherwise(0.0))
        return rows.groupBy("period").agg(F.round(F.avg("hit"), 6).alias("fitness"))

    grid = spark.range(1).select(F.explode(F.array(F.lit(2), F.lit(5), F.lit(10))).alias("period"))
    return Q.G.grid_search(W.with_pos(bars_events(spark, sf_dir)), grid, kernel, moved, 1)


@query("""select p_size::double as "Max", count(*) as n, sum(p_partkey)::double as total from part group by 1""")
def read_settings_xml(spark, sf_dir):
    path = Q.scratch(spark, "settings")
    genes = Q.table(spark, sf_dir, "part").select(F.col("p_name").alias("Name"), F.lit(0).alias("Min"), F.col("p_size").cast("int").alias("Max"), F.lit(1).alias("Granularity"), F.col("p_partkey").alias("Value"))
    genes.write.format("xml").option("rootTag", "Settings").option("rowTag", "VGene").save(path)
    return read(spark, path).groupBy("Max").agg(F.count(F.lit(1)).alias("n"), F.sum("Value").alias("total"))


@query("select o_orderkey as id, 'TRAIN' as kind, o_orderdate::date as start_date, 0.2::double as validation from orders")
def read_run_requests(spark, sf_dir):
    path = Q.scratch(spark, "requests")
    orders = Q.table(spark, sf_dir, "orders")
    text = F.format_string('{"Type":"TRAIN","ProtoRunName":"%d","StartDate":ISODate("%s"),"ValidationPct":0.2}', "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd"))
    orders.select(text).write.text(path)
    rows = parse(spark, path, a_line=True)
    return rows.select(F.col("ProtoRunName").cast("bigint").alias("id"), F.col("Type").alias("kind"), F.to_date("StartDate").alias("start_date"), F.col("ValidationPct").alias("validation"))
