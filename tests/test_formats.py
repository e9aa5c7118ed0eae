"""Sources and sinks on small files."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources import barfiles
from tidemark.sources import bars as B
from tidemark.sources import sinks


def test_read_bars(spark, tmp_path):
    (tmp_path / "ABC.txt").write_text("20100104;10.0;12.5;9.5;11.0;300\n20100105;11.0;11.5;10.0;10.5;200\n")
    rows = barfiles.read_bars(spark, str(tmp_path)).orderBy("ts").collect()
    assert tuple(rows[0]) == ("ABC", dt.datetime(2010, 1, 4), 10.0, 12.5, 9.5, 11.0, 300) and len(rows) == 2


def test_trade_log(spark):
    lines = spark.createDataFrame([("1/5/2011 1.25 100 125.0",), ("\t\t",), ("",), ("12/31/2011\t-2",), ("not a trade",)], "value string")
    assert [tuple(r) for r in B.read_trade_log(lines).orderBy("ts").collect()] == [(dt.datetime(2011, 1, 5), 1.25, 100, 125.0), (dt.datetime(2011, 12, 31), -2.0, None, None)]


def test_reports(spark, tmp_path):
    (tmp_path / "log.txt").write_text("head\n=== BEST ===\nStrategy : S1\nGenome : 1 2\nFitness : 0.75\nMinMajority: 0.54\n\n=== BEST ===\nStrategy : S2\nFitness : 0.5\n")
    rows = B.read_search_reports(spark, str(tmp_path)).orderBy("strategy").collect()
    assert [(r["strategy"], r["fitness"]) for r in rows] == [("S1", 0.75), ("S2", 0.5)] and rows[0]["params"]["MinMajority"] == "0.54"


def test_run_request(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"Type": "Run", "Symbol": "X",\n "StartDate": ISODate("2004-01-01"), "ValidationPct": 0.2}')
    r = B.read_run_requests(spark, str(tmp_path)).collect()[0]
    assert (r["Type"], r["Symbol"], r["StartDate"], r["ValidationPct"], r["EndDate"]) == ("Run", "X", "2004-01-01", 0.2, None)


def test_settings(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<Settings><Genes><VGene><Name>A</Name><Min>0</Min><Max>1</Max><Granularity>0.5</Granularity><Value>0.5</Value></VGene><VGene><Name>B</Name><Min>1</Min><Max>2</Max><Granularity>1</Granularity><Value>2</Value></VGene></Genes></Settings>")
    assert [tuple(r) for r in B.read_settings_xml(spark, str(tmp_path)).orderBy("Name").collect()] == [("A", 0, 1, 0.5, 0.5), ("B", 1, 2, 1, 2)]


def test_price_tables_and_links(spark):
    cell = "".join(f'<td class="tabledata1">{v}</td>' for v in ("Jan 5, 2004", "1,010.5", "1,020", "1,000", "1,015.25", "1,234,567", "1,015"))
    html = f'<table><tr>{cell}</tr><tr><td>x</td></tr><tr>{cell.replace("2004", "2001")}</tr></table><a href="/p?a=1&amp;b=2">Next</a>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert [tuple(r)[1:] for r in B.extract_price_tables(pages, "2003-01-01").collect()] == [(dt.datetime(2004, 1, 5), 1010.5, 1020.0, 1000.0, 1015.25, 1234567)]
    assert [r[0] for r in pages.orderBy("page_id").select(B.next_link(F.col("html"))).collect()] == ["/p?a=1&b=2", None, None]


def test_routes(spark):
    df = spark.createDataFrame([('{"Type":"A","x":1}',), ('{"Type":"B","y":"q"}',), ('{"Type":"C"}',), ("broken",), (None,)], "text string")
    out = B.decode_typed_json(df, "text", {"A": "struct<x:bigint>", "B": "struct<y:string>"}).collect()
    assert [r["route"] for r in out] == ["A", "B", "unknown", "unknown", "unknown"] and out[0]["A"]["x"] == 1


def test_exactly_one(spark):
    df = spark.range(3)
    assert B.exactly_one(df, F.col("id") == 1).collect()[0][0] == 1
    for bad in (F.col("id") > 0, F.col("id") > 9):
        with pytest.raises(Exception, match="exactly one"):
            B.exactly_one(df, bad).collect()


def test_vectors_as_text(spark):
    df = spark.createDataFrame([([1.5, -2.0],), ([],)], "v array<double>").select(sinks.vector_text("v").alias("t"))
    assert df.where("t <> ''").select(sinks.parse_vector("t")).first()[0] == [1.5, -2.0]


def test_new_rows(spark):
    day = lambda d: dt.datetime(2020, 1, d)
    old = spark.createDataFrame([("a", day(3)), ("b", day(1))], "symbol string, ts timestamp_ntz")
    new = spark.createDataFrame([(s, day(d)) for s in "ab" for d in range(1, 6)], "symbol string, ts timestamp_ntz")
    assert B.newer_than_stored(new, old).count() == 4 and B.newer_than_stored(new, old, per_symbol=True).count() == 6
    assert B.newer_than_stored(new, old.limit(0), "2020-01-05").count() == 2
