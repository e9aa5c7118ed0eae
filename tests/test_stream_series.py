"""Streaming means over ticks that tie in time: in one trigger and in several, with late rows, and stopped and begun again."""

from __future__ import annotations

import datetime as dt
import random
import time

import numpy as np
import pytest

from tidemark.streaming import ops

TICK = "symbol string, ts timestamp, id bigint, x double"


def at(second):
    return dt.datetime(2020, 1, 1) + dt.timedelta(seconds=second)


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, TICK).coalesce(1).write.parquet(f"{folder}/in{name}")


def drain(spark, folder, files, stream=ops.stream_mean, **options):
    rows = spark.readStream.schema(TICK).option("maxFilesPerTrigger", files).parquet(f"{folder}/in*")
    out = stream(rows, 3, **options)
    run = out.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    run.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    found = spark.read.schema(out.schema).parquet(f"{folder}/out").collect()
    assert len({(r["symbol"], r["id"]) for r in found}) == len(found)
    return {(r["symbol"], r["id"]): (None if r["late"] else r["value"], r["late"]) for r in found}, found


def plain(rows, figure):
    out, last = {}, {}
    for symbol, _, n, x in sorted(rows):
        own = last.setdefault(symbol, [])
        own.append(x)
        del own[:-3]
        out[symbol, n] = (pytest.approx(figure(own)), False)
    return out


@pytest.mark.parametrize("files", [1, 100])
def test_ticks_at_one_time_all_count(spark, tmp_path, files):
    rows = [("ab"[i % 2], at(i // 6), i, float(i * i % 17)) for i in range(60)]
    parts = [rows[:30], [r for r in rows[30:48] if r[0] == "a"], [r for r in rows[30:48] if r[0] == "b"] + rows[48:]]
    for k, part in enumerate(parts):
        random.Random(1).shuffle(part)
        put(spark, tmp_path, k, part)
    assert drain(spark, tmp_path, files)[0] == plain(rows, np.mean)


def test_rows_of_a_later_batch_are_late_and_counted(spark, tmp_path):
    put(spark, tmp_path, 0, [("a", at(5), 1, 1.0)])
    put(spark, tmp_path, 1, [("a", at(4), 2, 9.0), ("a", at(5), 3, 3.0), ("a", at(3), 4, 9.0)])
    put(spark, tmp_path, 2, [("a", at(1), 5, 9.0)])
    got, rows = drain(spark, tmp_path, 1)
    assert got == {("a", 1): (1.0, False), ("a", 2): (None, True), ("a", 3): (2.0, False), ("a", 4): (None, True), ("a", 5): (None, True)}
    assert max(r["n_late"] for r in rows) == 3


@pytest.mark.parametrize(("stream", "figure"), [(ops.stream_mean, np.mean), (ops.stream_std, np.std)])
def test_state_outlives_a_restart(spark, tmp_path, stream, figure):
    """Files come in three runs of the query, several triggers each; state and place come from the checkpoint."""
    rng = random.Random(4)
    rows = [(rng.choice("abc"), at(i // 3), i, rng.gauss(10, 3)) for i in range(240)]
    for run in range(3):
        for k in range(4):
            put(spark, tmp_path, f"{run}-{k}", rows[60 * run + 20 * k : 60 * run + 20 * (k + 1)] if k < 3 else [("d", at(1000 + run), 1000 + run, 1.0)])
        got, _ = drain(spark, tmp_path, 2, stream)
    first = rows[:180] + [("d", at(1000 + run), 1000 + run, 1.0) for run in range(3)]
    assert got == plain(first, figure)


def test_idle_series_are_forgotten(spark, tmp_path):
    put(spark, tmp_path, 0, [("a", at(1), 1, 1.0)])
    rows = ops.stream_mean(spark.readStream.schema(TICK).parquet(f"{tmp_path}/in*"), 3, ttl="2 seconds")
    run = rows.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").format("memory").queryName("idle").start()
    try:
        for k in (1, 2):
            deadline = time.time() + 30
            while spark.table("idle").count() < k and time.time() < deadline:
                time.sleep(0.5)
            if k == 1:
                time.sleep(3)
                put(spark, tmp_path, 1, [("a", at(2), 2, 5.0)])
    finally:
        run.stop()
    assert {(r["id"], r["value"]) for r in spark.table("idle").collect()} == {(1, 1.0), (2, 5.0)}


def test_average_forgets_over_triggers(spark, tmp_path):
    rows = [("a", at(i), i, float(i * 7 % 11)) for i in range(40)]
    for k in range(4):
        put(spark, tmp_path, k, rows[10 * k : 10 * (k + 1)])
    v, want = None, {}
    for _, _, n, x in rows:
        v = x if v is None else 0.5 * x + 0.5 * v
        want["a", n] = (pytest.approx(v), False)
    assert drain(spark, tmp_path, 1, ops.stream_ema)[0] == want


def test_windows_of_long_batches():
    xs = np.random.default_rng(1).normal(size=150_000)
    fold = ops.over_last(7, lambda x: x.mean(axis=-1))
    whole, kept = fold(np.array([]), xs)
    assert np.allclose(whole[6:], np.convolve(xs, np.ones(7) / 7, "valid")) and len(kept) == 6
    one, kept = fold(np.array([]), xs[:3])
    two, _ = fold(kept, xs[3:5])
    assert np.allclose(np.concatenate([one, two]), whole[:5])
