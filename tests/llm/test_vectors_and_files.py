"""Lattice links, MaxScore, WARC archives, token ids, the pipeline and the SQL of the queries."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import lattice, maxscore, tokens, warc
from tidemark.llm.queries import ORACLE_SQL, QUERIES, piece_model

VECTORS = "vec_id long, embedding array<float>, label int, id string, n string"


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 16))
    near = base[:40] + rng.normal(size=(40, 16)) * 0.15
    out = [(i, [float(x) for x in v], 0, "a", "b") for i, v in enumerate(np.concatenate([base, near]))]
    out += [(500, None, 0, "", ""), (501, [0.0] * 16, 0, "", ""), (502, [float("nan")] + [1.0] * 15, 0, "", ""), (503, [None] + [1.0] * 15, 0, "", "")]
    out += [(504, [], 0, "", ""), (505, [float("inf")] * 16, 0, "", ""), (506, out[3][1], 1, "", ""), (507, out[3][1], 1, "", ""), (508, [1.0, 2.0], 0, "", ""), (509, [2.0, 4.1], 0, "", ""), (None, out[3][1], 0, "", "")]
    return out


def test_links_equal_brute_force(spark):
    data = vectors()
    out = {r["vec_id"]: r for r in lattice.cosine_links(spark.createDataFrame(data, VECTORS)).collect()}
    good = {i: np.array(v, np.float64) for i, v, *_ in data if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    links = {i: {j for j in good if j != i and len(good[i]) == len(good[j]) and cos(good[i].astype(np.float32).astype(float), good[j].astype(np.float32).astype(float)) >= 0.9} for i in good}
    assert {i: out[i]["n_links"] for i in good} == {i: len(v) for i, v in links.items()}
    for i in good:
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        assert out[i]["component_id"] == min(seen) and out[i]["kept"] == (i == min(seen))
    for i in (500, 501, 502, 503, 504, 505):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True)
    assert (out[None]["n_links"], out[None]["component_id"], out[None]["kept"]) == (0, None, True)
    assert lattice.cosine_links(spark.createDataFrame([], VECTORS)).count() == 0


def test_large_cells_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 7)
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in np.r_[1.0, rng.normal(size=7) * 0.01]]) for i in range(50)]
    out = lattice.cosine_links(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert {r["n_links"] for r in out} == {49} and {r["component_id"] for r in out} == {0}


def test_lattice_points():
    x = np.random.default_rng(1).normal(size=(500, 8)) * 3
    p = lattice.nearest(x)
    twice = np.rint(2 * p)
    assert np.allclose(twice, 2 * p) and ((twice % 2 == twice[:, :1] % 2).all(axis=1)).all() and (np.rint(p.sum(axis=1)) % 2 == 0).all()
    for r in lattice.ROOTS:  # no neighbour is nearer
        assert (((x - p) ** 2).sum(axis=1) <= ((x - p - r) ** 2).sum(axis=1) + 1e-9).all()
    assert len(lattice.ROOTS) == 240 and np.allclose((lattice.ROOTS**2).sum(axis=1), 2)


@pytest.mark.parametrize("big", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, big):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 60)
    data = [(i, v, *r) for i, v, *r in vectors()] + [(600, [1e30] * 16, 0, "", "")] * big
    out = maxscore.top_k(spark.createDataFrame(data, VECTORS), maxscore.F.col("vec_id") % 50 == 0).collect()
    q = {}
    for i, v, *_ in data:
        if i is not None and v is not None and None not in v and np.isfinite(v).all():
            q[i] = [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = set()
    for i in (i for i in q if i % 50 == 0):
        best = sorted((-clip(sum(a * b for a, b in zip(q[i], q[j], strict=False))), j) for j in q if j != i)[:5]
        want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out} == want
    assert maxscore.top_k(spark.createDataFrame([], VECTORS), maxscore.F.col("vec_id") % 50 == 0).count() == 0


def test_pruned_search_is_exact():
    rng = np.random.default_rng(2)
    rows = np.floor(rng.standard_t(2, size=(1500, 24)) * 20) * (rng.random((1500, 24)) < 0.3)
    ids = np.arange(1500)
    for own in range(0, 1500, 100):
        got = maxscore.best_in_shard(rows, ids, rows[own], own, 5)
        s = rows @ rows[own]
        want = sorted((-s[i], i) for i in ids if i != own)[:5]
        assert list(zip((-got[1]).tolist(), got[0].tolist(), strict=True)) == [(float(a), int(b)) for a, b in want]


def test_search_of_any_size_and_depth(spark, monkeypatch):
    """k beyond a shard, equal and repeated rows, one huge component, negative best scores, ids that doubles can't hold."""
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 40)
    monkeypatch.setattr(maxscore, "GROUP_QUERIES", 3)
    monkeypatch.setattr(maxscore, "SUMMARIES", 2)
    rng = np.random.default_rng(9)
    ids = [*range(0, 240, 2), *(2**53 + i for i in range(60))]
    data = [(i, [float(x) for x in rng.normal(size=6)]) for i in ids]
    data += [data[3], data[3], (1000, data[3][1]), (1001, [1e200, *[0.1] * 5]), (1002, [-1.0]), (1003, [])]
    for k in (1, 200):
        out = maxscore.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), maxscore.F.col("vec_id") % 50 == 0, k).collect()
        q = [(i, [int(np.floor(x * 256)) for x in v]) for i, v in data]
        want = set()
        for i, v in ((i, v) for i, v in q if i % 50 == 0):
            scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=False)))), j) for j, w in q if j != i]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])}
        assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out} == want


def test_pairs_that_cannot_reach_the_threshold_are_left_out():
    shards = maxscore.pd.DataFrame({"shard": [0, 1], "high": [np.array([9.0, 1.0]), np.array([1.0, 1.0])], "low": [np.zeros(2)] * 2, "norm": [9.1, 1.4]})
    queries = maxscore.pd.DataFrame({"part": [0, 0], "vec_id": [5, 6], "query_key": [5, 6], "home": [9, 0], "threshold": [20, maxscore.NONE], "v": [np.array([3.0, 0.0])] * 2})
    got = maxscore.open_pairs(queries, shards)
    assert list(zip(got["shard"], got["vec_id"], strict=True)) == [(0, 5), (1, 6)]


PAGES = "page_id long, url string, html string, payload string, first string"


def pages():
    rng = random.Random(1)
    long = "<p>" + "x" * 200 + "</p>"
    noise = "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(3000))
    embedded = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", mtime=0).decode("latin-1")
    out = [(i, f"http://x/{i}?a=b&c=%20", f"page {i} " + noise[: 50 * i], "", "") for i in range(40)]
    return out + [(100, "u:é\r\n x", long, "", ""), (99, None, long, "", ""), (101, "", long, "", ""), (None, "u", long, "", ""), (102, "u", None, "", ""), (103, "u", "", "", ""), (104, "u", "short", "", ""), (105, "u", "short", "", ""), (106, "u", embedded * 20, "", ""), (99, "u", long, "", ""), (107, "u", noise * 300, "", "")]


@pytest.mark.parametrize("split", [300, 5000, 1 << 25])
def test_archives_come_back(spark, split):
    files = warc.write_warc(spark.createDataFrame(pages(), PAGES).repartition(3))
    out = warc.read_warc(spark, files, split=split).collect()
    first = {}
    for i, _, h, *_ in pages():
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, u, h, *_ in pages():
        body = (h or "").encode()
        to = first.get(h) if len(body) >= 100 and first.get(h) != i else None
        want.append((str(i), u or "", len(body), hashlib.sha256(body).hexdigest(), "revisit" if to is not None else "response", str(to)))
    got = [(str(r["page_id"]), r["url"] or "", r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in out]
    assert sorted(got) == sorted(want)
    assert all(r["record_type"] == "revisit" or hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in out)


def test_no_pages(spark):
    files = warc.write_warc(spark.createDataFrame([], PAGES))
    assert files.count() == 0 and warc.read_warc(spark, files).count() == 0


def test_false_members_are_not_taken(tmp_path):
    member = warc.member("1", None, b"", hashlib.sha256(b"").hexdigest(), None)
    inner = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = inner.compress(b"WARC/1.1\r\nX: " + member * 3) + inner.flush()  # members inside a stored block
    (tmp_path / "a.warc.gz").write_bytes(stored + member)
    assert len(list(warc.records_in(str(tmp_path / "a.warc.gz"), 1, len(stored) + len(member)))) == 1


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


TEXTS = [" \n\tabctheing▁ é日本語😀<s>0129.,\x00́İ​", " " * 20 + "ab\n", "abcdefghijklmnopqrstuvwxyz ", "αβγ где это ш 0123 ", "    t"]


def test_ids_equal_the_library(library):
    rng, e = random.Random(1), tokens.Encoder(piece_model(), room=200_000, pairs=2000)
    texts = ["".join(rng.choices(rng.choice(TEXTS), k=rng.randint(0, 120))) for _ in range(3000)]
    texts += [None, "", " ", "\n", "a" * 5000, " " * 3000, "€" * 100, "x" * 70 + " " + "ab" * 40, "\x00", "<unk> <s> </s> <0x41>"]
    for text, (n, ids, decoded) in zip(texts, e.summaries(texts), strict=True):
        want = library.encode(text or "")
        assert (n, ids, decoded) == (len(want), ",".join(map(str, want)), library.decode(want))
    for text in texts[:300]:
        assert e.encode(text) == library.encode(text or "")


def test_decode_equals_the_library(library):
    rng, e = random.Random(2), tokens.Encoder(piece_model())
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.choice([0, 1, 2])]) for _ in range(rng.randint(0, 8))]
        assert e.decode(ids) == library.decode(ids)


def test_columns_of_ids(spark, library):
    df = spark.createDataFrame([(1, "hello there", "x"), (2, None, "y"), (None, "", "z")], "doc_id long, text string, ids string")
    out = {r["doc_id"]: r for r in tokens.with_ids(df, piece_model()).collect()}
    assert out[1]["ids"] == library.encode("hello there") and out[2]["ids"] == [] and out[None]["decoded"] == ""
    assert tokens.with_digests(df.limit(0), piece_model()).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = ", ".join(f'"{c}"' for c in columns)
    text = lambda r: str(tuple(r))
    assert sorted(map(text, got.select(*columns).collect())) == sorted(map(text, con.sql(f"select {order} from ({ORACLE_SQL[name]})").fetchall()))


def test_pipeline_decisions(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "personal_data", "mix", "tokens"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.stored(stage(spark, kept, SF), "test")
        seen[name] = kept
        if name != "tokens":
            assert kept.columns == docs.columns
    from tidemark.llm.pii import base_spans

    assert all(not base_spans(r["text"]) for r in seen["personal_data"].select("text").collect())
    last = seen["tokens"].collect()
    assert len(last) == seen["mix"].count() and all(r["round_trip"] for r in last)
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    want = sorted((r["doc_id"], tuple(m.encode(r["text"]))) for r in seen["mix"].collect())
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in last) == want


def test_a_pair_counts_once_and_rows_stay_few(spark, monkeypatch):
    """A group of near copies shares most cells: its links are summed in tasks, some rows a vector, no list of pairs."""
    kept, store = {}, lattice.stored
    monkeypatch.setattr(lattice, "stored", lambda df, tag, *more: kept.setdefault(tag, store(df, tag, *more)))
    rng, n = np.random.default_rng(5), 1100
    data = [(i, [float(x) for x in np.r_[1.0, rng.normal(size=15) * 0.01]]) for i in range(n)]
    data += [(n, data[0][1]), (n + 1, data[0][1]), (n + 2, [-1.0] + [0.0] * 15), (n + 2, [-1.0, 0.01] + [0.0] * 14), (n + 3, [-1.0, 0.02] + [0.0] * 14)]
    out = lattice.cosine_links(spark.createDataFrame(data, VECTORS.split(", label")[0])).collect()
    assert {r["n_links"] for r in out if r["vec_id"] < n + 2} == {n + 1} and {r["component_id"] for r in out if r["vec_id"] < n + 2} == {0}
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out if r["vec_id"] >= n + 2) == [(n + 2, 1, n + 2), (n + 2, 1, n + 2), (n + 3, 2, n + 2)]
    assert kept["lattice-links"].count() < 20 * n


def test_cells_met_before_and_least_ids_equal_plain_loops():
    rng = np.random.default_rng(6)
    for _ in range(50):
        left, right = ([np.sort(rng.choice(40, rng.integers(0, 6), replace=False)).astype(np.int64) for _ in range(rng.integers(1, 9))] for _ in "ab")
        plain = [[bool(set(x.tolist()) & set(y.tolist())) for y in right] for x in left]
        assert lattice.met_before(left, right).tolist() == plain
        hit = rng.random((len(left), len(right))) < 0.2
        x, y = rng.permutation(100)[: len(left)], 100 + rng.permutation(100)[: len(right)]
        label = {int(v): int(v) for v in [*x, *y]}
        for _ in label:
            for i, j in np.argwhere(hit):
                label[int(x[i])] = label[int(y[j])] = min(label[int(x[i])], label[int(y[j])])
        a, b = lattice.least_linked(hit, x, y, False)
        assert a.tolist() == [label[int(v)] for v in x] and b.tolist() == [label[int(v)] for v in y]
