"""Mixing, shards, near duplicates, language, quality and personal data on small tables with all odd rows."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, minhash, mixing, pii, quality, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 80))), "en", f"s{i % 4}", 0, "x", "y") for i in range(n)]
    out += [(1000, None, None, None, None, None, None), (1001, "", "en", None, 0, "", ""), (1002, " \t\n", "en", "s0", 3, "", ""), (None, "no id at all here", "en", "s1", 0, "", "")]
    out += [out[5], out[5], (1003, out[6][1].upper(), "en", "s2", 0, "", ""), (1004, "lone", "de", "s3", 0, "", ""), (1005, "word " * 3000, "en", "s0", 0, "", "")]
    near = out[7][1].split() + [f"t{i}" for i in range(60)]
    return out + [(1010 + i, " ".join(near[: 20 + i] + [f"x{i}"] + near[21 + i :]), "en", "s1", 0, "", "") for i in range(4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mix_meets_targets_and_caps(docs, empty):
    out = mixing.mix_sources(docs).toPandas()
    assert len(out) == len(rows())
    assert (out["taken"] <= 2 * out["size"]).all() and (out["taken"] >= 0).all()
    for _, own in out.groupby("source", dropna=False):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 3
    assert out["target"].groupby(out["source"].fillna("null")).first().sum() == pytest.approx(1.5 * out["size"].sum())
    assert mixing.mix_sources(empty).count() == 0
    again = mixing.mix_sources(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, out[key].fillna(-1).values.tolist())) == sorted(map(tuple, again[key].fillna(-1).values.tolist()))


def test_apportionment_equals_its_definition(spark):
    rng = random.Random(3)
    for seats in (0, 1, 7, 100):
        votes = [rng.choice([0, 1, 5, 17, 400.5, 1000]) for _ in range(9)]
        df = spark.createDataFrame([(i, float(v), seats) for i, v in enumerate(votes)], "rank long, votes double, seats long")
        won = {r["rank"]: r["won"] for r in mixing.apportion(df, [], "rank", "votes", "seats").collect()}
        best = sorted(((v / (2 * k + 1), -i) for i, v in enumerate(votes) if v for k in range(seats)), reverse=True)[:seats]
        assert won == {i: sum(-b == i for _, b in best) for i in range(9)}


def test_mixed_texts_hold_the_words_taken(docs):
    small = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(small.dropDuplicates()).collect()}
    texts = mixing.mixed_texts(small.dropDuplicates()).collect()
    taken = collections.Counter()
    for r in texts:
        taken[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in plan.items() if v} == dict(taken)


def greedy(sizes, capacity):
    parts, room = 1, capacity
    for s in sizes:
        if s > room:
            parts, room = parts + 1, capacity
        room -= s
    return parts


def test_shards_are_minimax_and_gapless(docs, empty):
    out = sharding.shard_bytes(docs).toPandas()
    text = collections.Counter()
    assert len(out) == len(rows()) and set(out["law"]) == {"bytes"} and out["grown_shard"].isna().all()
    for own in (out[out["shard"] == s] for s in range(8)):
        assert sorted(own["slot"]) == list(range(len(own)))
    for i, t, *_ in rows():
        text[(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))] += 1
    assert text == collections.Counter((None if i != i else int(i), s, c) for i, s, c in zip(out["doc_id"], out["size"], out["text_crc32"], strict=True))
    assert (out.groupby("text_crc32")["shard"].nunique() == 1).sum() >= out["text_crc32"].nunique() - 1  # null and empty share a crc
    assert sharding.shard_bytes(empty).count() == 0


def test_cuts_are_the_least_feasible(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BINS", 5)
    rng = random.Random(5)
    for n, shards in ((1, 8), (5, 8), (60, 8), (300, 3)):
        sizes = [rng.choice([1, 2, 3, 50, 400]) for _ in range(n)]
        ends = np.cumsum(sizes)
        cuts = sharding.minimax_cuts(spark.createDataFrame([(int(e),) for e in ends], "end long"), "end", int(ends[-1]), shards)
        worst = max(np.diff([0, *cuts]))
        assert cuts[-1] == ends[-1] and set(cuts) <= set(ends.tolist())
        assert greedy(sizes, worst) <= shards and (worst == max(sizes) or greedy(sizes, worst - 1) > shards)


def sets_of(rows_):
    lower = {c: c + 32 for c in range(65, 91)}
    out = {}
    for i, t, *_ in rows_:
        w = WORD.findall((t or "").translate(lower))
        out[i] = frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def test_near_duplicates_equal_brute_force(docs, empty):
    sets = sets_of(r for r in rows() if r[0] is not None)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    out = minhash.near_duplicates(docs).collect()
    assert len(out) == len(rows())
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (root(r["doc_id"]), len(sets[r["doc_id"]]), root(r["doc_id"]) == r["doc_id"])
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out if r["kept"]}


def test_common_counts_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60))).astype(np.uint64) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets[11:]] for a in sets[:11]]
    for pairs in (1, 50, 1 << 20):
        minhash.PAIRS, old = pairs, minhash.PAIRS
        assert minhash.common(sets[:11], sets[11:]).tolist() == want
        minhash.PAIRS = old


def test_stragglers_are_linked_across_a_bucket(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[:k], *[f"v{k}_{j}" for j in range(3)], *base[k + 3 :]]) for k in range(0, 97, 4)]
    data = [(i, t) for i, t in enumerate(texts)] + [(100 + i, " ".join(base[: 60 + i])) for i in range(20)]
    out = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    sets = sets_of(data)
    parent = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and parent[b] > parent[a]:
                    parent[b], changed = parent[a], True
    assert {r["doc_id"]: r["component_id"] for r in out} == parent


def test_language_codes(spark, empty):
    rng = random.Random(2)
    words = {"aa": ["the", "house", "with", "thing"], "bb": ["der", "haus", "mit", "ding"], "cc": ["el", "casa", "con", "cosa"]}
    data = [(i, " ".join(rng.choices(words[k], k=12)), k) for i, k in enumerate(list(words) * 40)]
    data += [(500, None, "aa"), (501, "", "aa"), (502, "123 !!", "bb"), (503, "haus " * 20000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.with_language(df, df.where("doc_id % 4 <> 2")).collect()}
    assert all(out[i]["lang_pred"] == lang for i, _, lang in data[:120])
    assert [out[i]["lang_pred"] for i in (500, 501, 502, 503)] == ["und", "und", "und", "bb"]
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[500]["score"] == 0
    assert {r["doc_id"] for r in langid.accepted(df).collect()} == set(out) - {500, 501, 502}
    assert langid.with_language(df, df.limit(0)).where("lang_pred <> 'und'").count() == 0
    assert langid.with_language(empty, empty).count() == 0
    assert langid.accepted(empty.withColumnRenamed("score", "lang_pred")).columns == empty.withColumnRenamed("score", "lang_pred").columns


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9, 40):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n and (np.abs(code.sum(axis=0)) < n).all()


def test_margins_do_not_depend_on_batches():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(langid.BUCKETS + 1, 3))
    texts = ["", "a", "hello there" * 9, "é" * 70, "x y" * 90000]
    whole = langid.margins(texts, weights)
    assert np.allclose(whole, np.concatenate([langid.margins([t], weights) for t in texts]), rtol=1e-4, atol=1e-4)


def test_quality_ranks(spark, empty):
    rng = random.Random(4)
    good = [" ".join(rng.choices([f"w{i}" for i in range(99)], k=40)) for _ in range(60)]
    bad = ["WIN !!! $$$ " * 15 if i % 2 else "same " * 50 for i in range(20)]
    data = [(i, t) for i, t in enumerate(good + bad)] + [(200, None), (201, ""), (202, "b" * 100000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(80)] + [(5, None), (999, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.scored(docs, labels, F.col("doc_id") >= 0).collect()}
    assert len(out) == 83 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert sum(out[i]["predicted"] == int(i < 60) for i in range(80)) >= 78
    only = quality.scored(docs, labels.where("quality = 1"), F.col("doc_id") >= 0).collect()
    assert {round(r["score"], 6) for r in only} == {0.3}
    assert quality.scored(empty, labels, F.col("doc_id") >= 0).count() == 0


E_ = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PATTERNS = {"ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}
HOLDS = {"ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(d), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15}


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    for _ in range(4000):
        t = "".join(rng.choice(rng.choice(["a.@1-", "0123456789", "1 .-", "+1() .-5", "é٣@b.c", "4242 4", "1.2.3.44.255"])) for _ in range(rng.randint(0, 40)))
        want = [("email", m.start(), m.end()) for m in E_.finditer(t)] + [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in p.finditer(t) if HOLDS[k](m[0])]
        assert pii.base_spans(t) == sorted(want, key=lambda s: (s[1], pii.KINDS.index(s[0])))
    assert pii.base_spans(None) == [] and pii.base_spans("a" * 200000 + "@b") == []


def test_gradients():
    rng = np.random.default_rng(0)
    t = pii.Tagger()
    x, y, mask = rng.integers(0, pii.CLASSES, (3, 7)), np.zeros((3, 7), int), np.ones((3, 7), bool)
    y[0, 1], y[0, 2], y[2, 3], mask[1, 5:] = 1, 2, 5, False
    _, g = t.step(x, y, mask)
    for k in t.p:
        at = tuple(rng.integers(0, n) for n in t.p[k].shape)
        keep = t.p[k][at]
        t.p[k][at] = keep + 1e-5
        up = t.step(x, y, mask)[0]
        t.p[k][at] = keep - 1e-5
        down = t.step(x, y, mask)[0]
        t.p[k][at] = keep
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def personal(n):
    rng = random.Random(8)
    kinds = [lambda: f"{rng.choice('abcd')}x.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com", lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), lambda: "4111111111111111"]
    return [f"some words {kinds[i % 4]()} and more version 2.0 of it" for i in range(n)]


def test_network_learns_the_spans():
    texts = personal(200)
    tagger = pii.train(texts[:160])
    found = pii.all_spans(texts[160:], [[] for _ in texts[160:]], tagger)
    base = [pii.base_spans(t) for t in texts[160:]]
    hit = sum(s in f for f, b in zip(found, base, strict=True) for s in b)
    assert hit >= 0.7 * sum(map(len, base)) and sum(map(len, found)) - hit <= 2


def test_windows_cover_all_that_matters():
    text = "x" * 100 + "1" * 130 + "y" * 100
    assert {i for a, b in pii.windows(text) for i in range(a, b)} == set(range(76, 254))
    assert pii.windows("no trigger") == []


def test_spans_and_redaction(spark, empty):
    data = [(i, t) for i, t in enumerate(personal(80))] + [(100, None), (101, ""), (102, "clean text"), (None, "a.b@c.de"), (103, "z " * 60000 + "1.2.3.4")]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in data], "doc_id long, text string, n_chars long, spans string")
    out = {r["doc_id"]: r for r in pii.with_spans(docs).collect()}
    assert out[102]["spans"] == "" and out[103]["spans"] == "ip:120000:120007" and out[None]["n_email"] == 1 and out[100]["n_ip"] == 0
    for i, t in data:
        base = pii.written(pii.base_spans(t))
        assert set(base.split(",")) <= set(out[i]["spans"].split(",")) or base == ""
    clean = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert clean[0]["text"].startswith("some words <EMAIL> and") and clean[100]["text"] is None and clean[102]["text"] == "clean text"
    assert clean[103]["text"].endswith("<IP>") and clean[103]["n_chars"] == len(clean[103]["text"]) and clean[0]["spans"] == "k"
    assert pii.with_spans(empty).count() == 0 and pii.redacted(empty).count() == 0
