"""Directions, readouts and experts beside numpy; dispatched messages, bar files and entity trees on small tables."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import models as M
from tidemark.operators import search as G
from tidemark.operators import views as V
from tidemark.sources import barfiles
from tidemark.sources import bars as B
from tidemark.sources.sinks import store_append, store_read
from tidemark.streaming import ops


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    return rng.normal(size=(400, 6)) * np.array([5, 4, 3, 2, 1, 0.5]) + 3


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame([(i, x.tolist(), float(x @ [1, -2, 0.5, 0, 0, 1] + 7)) for i, x in enumerate(data)], "t long, features array<double>, y double").repartition(5)


@pytest.mark.parametrize(("subset", "complement"), [(None, False), (4, False), (3, True)])
def test_directions_of_tailored_inputs(rows, data, subset, complement):
    x = data[:, :subset]
    x = np.c_[x, 1 - x] if complement else x
    found = M.directions(*M.gram(rows, "features"), subset, complement)
    values, want = np.linalg.eigh(np.cov(x.T, bias=True))
    for k in range(3):
        assert abs(found[k] @ want[:, -1 - k]) == pytest.approx(1, abs=1e-9)
        got = {r["t"]: r["v"] for r in M.tailor_inputs(rows, "features", "v", subset, complement, k).select("t", "v").collect()}
        assert np.allclose([got[i] for i in range(len(x))], np.outer(x @ want[:, -1 - k], want[:, -1 - k]))


def test_no_rows_have_no_directions(rows):
    assert M.gram(rows.limit(0), "features")[0] == 0 and M.pca_basis(rows.limit(0), "features", 2) == []
    assert M.least_squares_readout(rows.limit(0), "features", "y")[2]


@pytest.mark.parametrize("parts", [1, 40])
def test_readout_equals_least_squares(rows, data, parts):
    w, bias, bad = M.least_squares_readout(rows.repartition(parts), "features", "y", at_once=3)
    assert not bad and w == pytest.approx([1, -2, 0.5, 0, 0, 1], abs=1e-9) and bias == pytest.approx(7)
    noisy = rows.withColumn("y", F.col("y") + F.sin("t"))
    w, bias, _ = M.least_squares_readout(noisy.repartition(parts), "features", "y", at_once=3)
    y = data @ [1, -2, 0.5, 0, 0, 1] + 7 + np.sin(np.arange(len(data)))
    assert np.allclose([*w, bias], np.linalg.lstsq(np.c_[data, np.ones(len(data))], y, rcond=None)[0])


@pytest.mark.parametrize("column", ["features[0]", "2D", "features[1] - 3 * features[2]", "0D"])
def test_a_readout_without_a_single_solution_is_degenerate(rows, column):
    own = rows.withColumn("h", F.concat("features", F.array(F.expr(column))))
    assert M.least_squares_readout(own, "h", "y") == ([0.0] * 7, 0.0, True)
    assert M.least_squares_readout(rows.limit(4), "features", "y")[2]


def test_experts_see_inputs_of_their_own_genes(spark, rows, data):
    genes = [(None, False, None), (3, False, None), (4, True, None), (5, False, 1), (3, True, 0), (3, True, 40)]
    center = {}
    for i, (subset, complement, component) in enumerate(genes):
        x = data[:, :subset]
        x = np.c_[x, 1 - x] if complement else x
        if component is not None:
            d = np.linalg.eigh(np.cov(x.T, bias=True))[1].T[::-1][min(component, x.shape[1] - 1)]
            x = np.outer(x @ d, d)
        center[i] = x
    made = [("m", i, s, c, k, 0.5, 6.0, i == 1, [(center[i][7].tolist(), 2.0)]) for i, (s, c, k) in enumerate(genes)]
    experts = spark.createDataFrame(made, "mixture string, expert long, subset int, complement boolean, component int, bias double, spread double, degenerate boolean, bases array<struct<center:array<double>,weight:double>>")
    for most in (0, 100):
        got = {(r["expert"], r["t"]): r["prediction"] for r in M.expert_predictions(rows, experts, most).collect()}
        assert len(got) == len(genes) * len(data)
        for i in (0, 2, 3, 4):
            want = 0.5 + 2 * np.exp(-((center[i] - center[i][7]) ** 2).sum(axis=1) / 36)
            assert np.allclose([got[i, t] for t in range(len(data))], want)
        assert all(got[1, t] == 0 for t in range(len(data)))


HANDLERS = [B.Handler("big", "order", "struct<id:bigint,price:double>", ("id", "price"), "r.price > 100"), B.Handler("small", "order", "struct<id:bigint,price:double>", ("id",)), B.Handler("note", "note", "struct<text:string>", ("text",))]
MESSAGES = {
    1: '{"Type":"order","id":1,"price":500}', 2: '{"Type":"order","id":2,"price":5}', 3: '{"Type":"order","price":5}', 4: '{"Type":"note","text":"x"}', 5: '{"text":"no type"}',
    6: '{"Type":"bill"}', 7: "no json", 8: None, 9: "[1]", 10: '{"Type":"note"}', 11: '{"Type":"order","id":3}',
}
ROUTES = {1: ("big", None), 2: ("small", None), 3: ("unknown", "order: lacks id"), 4: ("note", None), 5: ("unknown", "no type"), 6: ("unknown", "no handler for bill"), 7: ("unknown", "no JSON object"), 8: ("unknown", "no JSON object"), 9: ("unknown", "no JSON object"), 10: ("unknown", "note: lacks text"), 11: ("small", None)}


def test_the_first_handler_that_takes_a_message_has_it(spark):
    out = B.dispatched(spark.createDataFrame(list(MESSAGES.items()), "n long, text string"), "text", HANDLERS).collect()
    assert {r["n"]: (r["route"], r["error"]) for r in out} == ROUTES
    assert {r["n"]: r["small"]["id"] for r in out if r["small"]} == {2: 2, 11: 3} and {r["n"]: r["big"]["id"] for r in out if r["big"]} == {1: 1}


def test_messages_are_delivered_once(spark, tmp_path, monkeypatch):
    """A trigger breaks off between two stores and is run again; files that come later are a trigger of their own."""
    schema = "n long, text string"
    put = lambda k, items: spark.createDataFrame(items, schema).coalesce(1).write.json(f"{tmp_path}/in{k}")
    put(0, list(MESSAGES.items())[:6])
    real, calls = ops.store_append, []

    def failing(*a):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("lost between two stores")
        return real(*a)

    def run():
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in*")
        ops.route(stream, "text", HANDLERS, f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    monkeypatch.setattr(ops, "store_append", failing)
    with pytest.raises(Exception, match="lost between two stores"):
        run()
    run()
    put(1, list(MESSAGES.items())[6:])
    run()
    run()
    got = []
    for name in ("big", "small", "note", "unknown"):
        ddl = "n long, text string, error string" if name == "unknown" else f"n long, {name} {next(h.schema for h in HANDLERS if h.route == name)}"
        got += [(r["n"], name) for r in store_read(spark, f"{tmp_path}/out/{name}", T.StructType.fromDDL(ddl)).collect()]
    assert sorted(got) == sorted((n, r) for n, (r, _) in ROUTES.items())


def test_files_of_other_symbols_stay_closed(spark, tmp_path):
    (tmp_path / "AA.txt").write_text("20200101;1;4;0.5;2;10\n20200102;2;5;1;3;20\n20200301;3;6;2;4;30\n")
    (tmp_path / "symbol=B%20B").mkdir()
    (tmp_path / "symbol=B%20B" / "part-0.csv").write_text("20200102;1;1;1;1;1\n")
    (tmp_path / "CC.txt").write_text("this is no bar file\n")
    (tmp_path / "_SUCCESS").write_text("")
    read = lambda *a: barfiles.read_bars(spark, str(tmp_path), *a)
    one, two = read(["B B"]), read(["AA", "B B"], "2020-01-02", "2020-02-01")
    assert [tuple(r) for r in one.collect()] == [("B B", dt.datetime(2020, 1, 2), 1, 1, 1, 1, 1)]
    assert [(r["symbol"], r["close"], r["volume"]) for r in two.orderBy("symbol").collect()] == [("AA", 3.0, 20), ("B B", 1.0, 1)]
    assert read([]).count() == 0 and read(["none"]).count() == 0
    both = two.where("symbol = 'AA'").unionAll(two.where("symbol = 'B B'")).unionAll(two).unionAll(one)
    assert both.count() == 5  # one table, filtered otherwise in each place
    with pytest.raises(Exception, match="CSV|columns"):
        read().count()


def test_trees_that_lack_a_part_go(spark):
    make = spark.createDataFrame
    runs = make([(1,), (2,), (3,), (4,)], "run_id long")
    generations = make([(10, 1, 0), (11, 1, 1), (20, 2, 0), (30, 3, 0), (40, 4, 0)], "generation_id long, run_id long, generation long")
    gen_evals = make([(10, 0.5), (11, 0.75), (20, 0.1), (20, 0.2), (40, 0.3)], "generation_id long, fitness double")  # 20 has two, 30 none
    mixtures = make([(m, 10) for m in range(100, 107)] + [(110, 11), (200, 20), (300, 30), (400, 40)], "mixture_id long, generation_id long")
    evals = make([(m, m / 1000) for m in [*range(100, 107), 110, 200, 300]], "mixture_id long, fitness double")  # 400 has none
    experts = V.experts_of_mixture(make([(100, 1, "rbf", 7), (100, 0, "rbf", 9)], "mixture_id long, ord long, kind string, id long"), make([(100, 2, "rnn", 8, 1)], "mixture_id long, ord long, kind string, id long, more int"))
    out = V.entity_tree(runs, generations, gen_evals, mixtures, evals, experts, 3).orderBy("run_id", "generation", "part").collect()
    assert [(r["run_id"], r["generation"], r["part"], r["fitness"], [m["mixture_id"] for m in r["mixtures"]]) for r in out] == [
        (1, 0, 0, 0.5, [100, 101, 102]), (1, 0, 1, 0.5, [103, 104, 105]), (1, 0, 2, 0.5, [106]), (1, 1, 0, 0.75, [110]),
    ]
    assert [(e["kind"], e["id"]) for e in out[0]["mixtures"][0]["experts"]] == [("rbf", 9), ("rbf", 7), ("rnn", 8)] and out[0]["mixtures"][1]["experts"] == []


def test_candidates_are_fitted_on_inputs_of_their_own_genes(spark):
    """Slices cut, complement coded and projected on a direction of their own, against numpy; slices in several blocks."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]
    y = np.where(x[:, 0] + x[:, 3] > 0, 1.0, -1.0)
    rows = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "row long, x array<double>, y double").repartition(3)
    genes = [(None, None, None), (4, False, None), (4, True, None), (None, False, 0), (3, True, 1), (3, True, 1), (5, None, 99)]
    own = [(i, 0.1 * (i % 3), 0.5, 0.5, *g) for i, g in enumerate(genes)]
    candidates = spark.createDataFrame(own, "candidate long, offset double, size double, spread double, subset int, complement boolean, component int")
    fitted = M.written(M.train_candidates(candidates, rows, rows_at_once=70, candidates_at_once=3))
    scores = {r["candidate"]: r["fitness"] for r in M.candidate_fitness(rows, fitted, 90, 2).collect()}
    found = {r["candidate"]: r for r in fitted.collect()}
    assert found.keys() == scores.keys() == set(range(len(genes)))
    for i, (subset, complement, component) in enumerate(genes):
        start = int(0.1 * (i % 3) * 400)
        v = x[:, :subset]
        v = np.c_[v, 1 - v] if complement else v
        if component is not None:
            direction = np.linalg.eigh(np.cov(v[start : start + 200].T))[1][:, ::-1].T[min(component, v.shape[1] - 1)]
            v = np.outer(v @ direction, direction)
        at = v[start : start + 200 : 25]
        phi = np.c_[np.exp(-((v[:, None] - at[None]) ** 2).sum(axis=2) / 0.25), np.ones(400)]
        w = np.linalg.lstsq(phi[start : start + 200], y[start : start + 200], rcond=1e-6)[0]
        assert np.allclose(np.array(found[i]["centers"]), at, atol=1e-8)
        assert np.allclose(phi @ np.array(found[i]["weights"]), phi @ w, atol=1e-2)
        assert scores[i] == pytest.approx((np.sign(phi @ w) == y).mean(), abs=0.01)
        assert found[i]["seconds"] > 0 and (found[i]["basis"] is None) == (component is None)


def test_every_generation_is_full(spark):
    """However fit its parents are: by share, all of none, or one alone of some."""
    specs = spark.createDataFrame([("a", 0.0, 10.0, 0.5), ("b", -5.0, 5.0, 0.0)], "name string, min double, max double, granularity double")
    total = lambda genes: genes.groupBy("candidate").agg(F.sum("value").alias("t"))
    for fitness in (1 / (1 + F.abs("t")), -F.abs("t"), F.when(F.col("candidate") == 3, 1.0).otherwise(0.0)):
        out = G.evolve(spark, specs, lambda genes: total(genes).select("candidate", fitness.alias("fitness")), 9, 4, 3, 0.1, 7)  # noqa: B023
        assert {(r["generation"], r["candidate"]) for r in out.collect()} == {(g, c) for g in range(3) for c in range(9)}
