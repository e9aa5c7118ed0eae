"""Queries that take all of their tables, beside loops over the same tables."""

from __future__ import annotations

import datetime as dt
import itertools
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import queries as Q
from tidemark.streaming import ops

SF = "/root/testdata/sf0.001"


def test_whole_share_backtest_takes_every_bar(spark):
    bars = Q.B.bars_orders(spark, SF).orderBy("symbol", "ts").collect()
    want = {}
    for symbol, own in itertools.groupby(bars, lambda r: r["symbol"]):
        value, own = 1e9, list(own)
        want[symbol, own[0]["ts"]] = (0, value)
        for old, new in itertools.pairwise(own):
            side = 1 if old["close"] > old["open"] else -1
            shares = max(0, int(value // old["close"]))
            value += side * shares * (new["close"] - old["close"])
            want[symbol, new["ts"]] = (side * shares, value)
    got = {(r["symbol"], r["ts"]): r for r in Q.QUERIES["whole_share_backtest"](spark, SF).collect()}
    assert got.keys() == want.keys() and len(want) > 5 * 61
    for key, (shares, value) in want.items():
        assert got[key]["shares"] == shares and got[key]["value"] == pytest.approx(value, abs=0.01)


def test_every_order_becomes_a_report(spark):
    orders = Q.table(spark, SF, "orders").collect()
    want = sorted((f"S{r['o_orderkey'] % 7}", round(float(r["o_totalprice"]), 2), str(r["o_custkey"] % 9)) for r in orders)
    assert sorted(map(tuple, Q.QUERIES["read_search_reports"](spark, SF).collect())) == want


def test_candidates_are_fitted_and_scored_on_all_rows(spark, monkeypatch):
    score, train, fits = Q.M.candidate_fitness, Q.M.train_candidates, []
    monkeypatch.setattr(Q.M, "candidate_fitness", lambda rows, fitted: score(rows.repartition(3), fitted, 70, 3))
    monkeypatch.setattr(Q.M, "train_candidates", lambda own, rows: fits.append(train(own, rows.repartition(3), Q.M.CENTERS, 60, 3)) or fits[0])
    got = {r["candidate"]: r["fitness"] for r in Q.QUERIES["candidate_training"](spark, SF).collect()}
    rows = sorted(Q.table(spark, SF, "embeddings").collect(), key=lambda r: r["vec_id"])
    x, y = np.array([r["embedding"] for r in rows], float), np.array([1.0 if r["label"] % 2 else -1.0 for r in rows])
    assert len(rows) == 500 and len(got) == 10
    for c in fits[0].collect():
        start, n = int(c["candidate"] % 10 / 20 * len(x)), int(0.4 * len(x))
        own, at = slice(start, start + n), x[start : start + n : n // 8][:8]
        assert np.allclose(np.array(c["centers"]), at)
        phi = lambda v: np.c_[np.exp(-((v[:, None, :] - at[None]) ** 2).sum(axis=2) / c["spread"] ** 2), np.ones(len(v))]  # noqa: B023, E731
        w = np.linalg.lstsq(phi(x[own]), y[own], rcond=None)[0]
        assert np.allclose(phi(x) @ np.array(c["weights"]), phi(x) @ w, atol=1e-4)
        assert got[c["candidate"]] == pytest.approx((np.sign(phi(x) @ w) == y).mean(), abs=0.005)


def vectors(spark):
    return {r["vec_id"]: [float(v) for v in r["embedding"]] for r in Q.table(spark, SF, "embeddings").collect()}


def test_vectors_are_taken_whole(spark):
    own = vectors(spark)
    got = {(r["vec_id"], r["k"]): r["value"] for r in Q.QUERIES["flatten_population"](spark, SF).collect()}
    assert got == {(i, k): pytest.approx(x, abs=1e-6) for i, v in own.items() for k, x in enumerate(v)} and len(got) == 64 * len(own)
    got = {(r["pair"], r["ord"], r["name"]): (r["x"], r["y"]) for r in Q.QUERIES["crossover"](spark, SF).collect()}
    want = {(i, k, f"g{k}"): (own[i + 1][k - 1], v[k - 1]) if (i * 7919 + k * 31 + 13) % 1000 < 500 else (v[k - 1], own[i + 1][k - 1]) for i, v in own.items() if i + 1 in own for k in range(1, 65)}
    assert got == want


def test_matrix_of_all_labels_is_turned_in_blocks(spark):
    own = vectors(spark)
    got = {r["col"]: (r["n"], r["total"]) for r in Q.QUERIES["series_to_matrix"](spark, SF).collect()}
    assert got == {k: (len(own), pytest.approx(sum(v[k] for v in own.values()), abs=1e-3)) for k in range(64)}
    rows = spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(25)], "row long, values array<double>")
    blocks = {(r["col"], r["block"]): r["values"] for r in Q.M.transpose(rows, 10).collect()}
    assert blocks == {(c, b): [float(i * (1 - 2 * c)) for i in range(10 * b, min(25, 10 * b + 10))] for c in (0, 1) for b in range(3)}


def test_items_are_picked_from_buckets(spark):
    items = [(i * 3, float(i % 5)) for i in range(200)]
    total, upto, want = sum(q for _, q in items), 0.0, {}
    picks = [(n, (n + 0.5) / 300) for n in range(300)]
    for i, q in items:
        want |= {n: i for n, u in picks if upto / total <= u < (upto + q) / total}
        upto += q
    rows = Q.G.weighted_pick(spark.createDataFrame(items, "id long, quality double"), spark.createDataFrame(picks, "pick long, u double"), 16)
    assert sorted(map(tuple, rows.collect())) == sorted(want.items()) and len(want) == 300
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Window" in x and "id#" in x and "[_b#" not in x for x in plan.splitlines())  # no window over all ids


def test_accounts_outgrow_a_bigint(spark):
    bars = [("a", dt.datetime(2020, 1, 1) + dt.timedelta(i), 1e5 + i, 3.0, 4.0, 2.0, 3.5) for i in range(12)]
    rows = spark.createDataFrame(bars, "symbol string, ts timestamp_ntz, gain double, open double, high double, low double, close double")
    got = Q.T.discretionary_sized(rows, 1e6, 0.01).orderBy("ts").collect()
    value, sizes = 1e6, []
    for r, (_, _, gain, start, *_) in zip(got, bars, strict=True):
        sizes.append(int(value / start))
        assert r["size"] == sizes[-1] and r["value_before"] == pytest.approx(value, rel=1e-12)
        value += (start + gain - start) * 0.01 * sizes[-1]
        assert r["value_after"] == pytest.approx(value, rel=1e-12)
    assert sizes[0] == 333333 and sizes[-1] > 2**63


def test_sized_trades_of_a_long_log_go_on(spark):
    """The SQL of discretionary_sized on more bars than its bigint holds out for, with sizes as doubles instead."""
    path = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"create view orders as select * from read_parquet('{path}/orders.parquet')")
    text = Q.SQL["discretionary_sized"].replace(")::bigint,", ")::double,").replace(")::bigint as size", ")::double as size")
    want = {(s, ts): (size, value) for s, ts, size, value in con.sql(f"select symbol, ts, size, value_after from ({text})").fetchall()}
    got = {(r["symbol"], r["ts"]): r for r in Q.QUERIES["discretionary_sized"](spark, path).collect()}
    assert got.keys() == want.keys() and len(want) == 5 * 2405
    for key, (size, value) in want.items():
        assert got[key]["value_after"] == pytest.approx(value, rel=1e-9)
        assert got[key]["size"] is None if size >= 2**63 else got[key]["size"] == pytest.approx(size, rel=1e-9, abs=1)
    assert any(r["size"] is None for r in got.values())


def test_candidates_alike_share_a_fit(spark, monkeypatch):
    """Sixty candidates of six settings, nulls among them: six fits, and what each candidate gets alone."""
    met, slices = [], Q.M.over_slices
    monkeypatch.setattr(Q.M, "over_slices", lambda own, *rest: met.append(own.count()) or slices(own, *rest))
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist(), 1.0 - 2 * (i % 2)) for i in range(200)], "row long, x array<double>, y double")
    genes = [(None, None, None), (2, True, None), (3, False, 0)]
    own = [(i, 0.2 * (i % 2), 0.5, 1.0, *genes[i % 3]) for i in range(60)]
    schema = "candidate long, offset double, size double, spread double, subset int, complement boolean, component int"
    fitted = Q.G.written(Q.M.train_candidates(spark.createDataFrame(own, schema), rows, 4, 50, 8))
    got = {r["candidate"]: r for r in fitted.collect()}
    scores = {r["candidate"]: r["fitness"] for r in Q.M.candidate_fitness(rows, fitted, 50, 8).collect()}
    assert got.keys() == scores.keys() == set(range(60)) and met == [2, 6]  # two slices to take directions of
    alone = {r["candidate"]: r for r in Q.M.train_candidates(spark.createDataFrame(own[:6], schema), rows, 4, 50, 8).collect()}
    for i, r in got.items():
        assert r["fit"] == i % 6 and scores[i] == scores[i % 6]
        assert np.allclose(np.array(r["weights"]), alone[i % 6]["weights"]) and np.allclose(np.array(r["centers"]), alone[i % 6]["centers"])


def test_work_of_candidate_training_ends_with_its_settings(spark, monkeypatch):
    """More suppliers of the same thirty settings: as many fits, and as many fitted candidates meet the rows."""
    met, slices, table = [], Q.M.over_slices, Q.table
    monkeypatch.setattr(Q.M, "over_slices", lambda own, *rest: met.append(own.count()) or slices(own, *rest))
    more = spark.range(1, 301).select(F.col("id").alias("s_suppkey"))
    monkeypatch.setattr(Q, "table", lambda spark, sf_dir, name: more if name == "supplier" else table(spark, sf_dir, name))
    got = {r["candidate"]: r["fitness"] for r in Q.QUERIES["candidate_training"](spark, SF).collect()}
    assert met == [30] and got.keys() == set(range(1, 301))
    assert all(f == got[(i - 1) % 30 + 1] for i, f in got.items())


def test_shuffles_of_candidates_follow_the_rows_not_their_product(spark, monkeypatch):
    """Ten times the suppliers, same vectors: the bytes shuffled by both queries hardly grow (by chunks of 256 they grew as suppliers)."""
    table, moved = Q.table, {}

    def shuffled() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(e.totalShuffleWrite() for e in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(True)))

    for name, n in itertools.product(("candidate_training", "tailored_training"), (300, 3000)):
        more = spark.range(1, n + 1).select(F.col("id").alias("s_suppkey"))
        monkeypatch.setattr(Q, "table", lambda spark, sf_dir, which, more=more: more if which == "supplier" else table(spark, sf_dir, which))
        before = shuffled()
        assert Q.QUERIES[name](spark, SF).count() == n
        moved[name, n] = shuffled() - before
    for name in ("candidate_training", "tailored_training"):
        assert 0 < moved[name, 3000] < 2 * moved[name, 300], moved


def test_accounts_of_a_stream_share_buckets(spark, tmp_path):
    """Forty accounts, one without a name, in three buckets over two triggers: rows as in one batch, and three states, not forty."""
    rng = np.random.default_rng(3)
    orders = [(f"a{i % 40}" if i % 40 else None, "xyz"[rng.integers(3)], i, ("buy", "sell", "short", "cover")[rng.integers(4)], int(rng.integers(1, 9)), float(rng.integers(1, 50))) for i in range(2000)]
    schema = "account string, symbol string, seq long, action string, shares long, price double"
    for part in (orders[:1000], orders[1000:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/orders")
    first = min((p for p in (tmp_path / "orders").glob("part-*")), key=lambda p: spark.read.parquet(str(p)).agg(F.min("seq")).first()[0])
    os.utime(first, (1, 1))  # files are taken by age
    rows = ops.stream_ledger(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/orders"), 300.0, 4.0, 1.0, 3)
    run = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    done = [p for p in run.recentProgress if p["numInputRows"]]
    assert len(done) == 2 and done[-1]["stateOperators"][0]["numRowsTotal"] == 3
    got = {r["seq"]: tuple(r) for r in spark.read.schema(rows.schema).parquet(f"{tmp_path}/out").collect()}
    want = {r["seq"]: tuple(r) for r in Q.T.position_ledger(spark.createDataFrame(orders, schema), 300.0, 4.0, 1.0).collect()}
    assert got == want and len(want) == 2000
    held, equity = {}, 300.0  # an account by hand, as far as it may go
    for seq, (account, symbol, _, action, shares, price) in enumerate(orders):
        if account != "a7":
            continue
        n, average = held.get(symbol, (0, 0.0))
        sign, invested = 1 if action in ("buy", "sell") else -1, sum(abs(k) * c for k, c in held.values())
        if n * sign >= 0 and action in ("buy", "short") and shares * price <= (equity - 1) * 4 - invested:
            held[symbol], equity = (n + sign * shares, (abs(n) * average + shares * price) / (abs(n) + shares)), equity - 1
        elif n * sign > 0 and action in ("sell", "cover") and shares <= abs(n):
            held[symbol], equity = (n - sign * shares, average if abs(n) > shares else 0.0), equity + sign * shares * (price - average) - 1
        assert got[seq][9] == pytest.approx(equity) and got[seq][10] == pytest.approx(sum(abs(k) * c for k, c in held.values()))
