"""Mixed texts are contiguous runs of their sources; columns of any name pass through."""

from __future__ import annotations

import collections
import random
import re

import pytest

from tidemark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operator uses inside, and its new columns.
NAMES = ["row", "id", "spot", "turn", "last", "rank", "weight", "cap", "level", "shards", "shard", "of", "quota", "seats", "won", "cell_size", "blocks", "rough", "gap", "n", "i", "wanted", "rest", "j", "length", "more", "start", "end", "split", "run", "piece", *mixing.NEW, "_k", "_won"]


def table(spark, n=150):
    rng = random.Random(5)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(rng.choice([0, 1, 30, 90, 700]))), f"s{i % 3}" if i % 7 else None, 1) for i in range(n)]
    rows += [(1000, " ".join(f"long{k}" for k in range(60_000)), "s1", 1), (1001, None, "s0", 1), (None, "a b c", "s0", 1), (None, "d e", "s0", 1), (2**53 + 1, "big id", "s2", 1), rows[3], rows[3], (5, "same id other text", "s2", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")


def test_texts_are_runs_of_at_least_a_block_or_whole(spark):
    rows, docs = table(spark)
    texts = collections.defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t or "")
    out = mixing.mixed_texts(docs).collect()
    plan = mixing.mix_sources(docs).collect()
    assert sum(r["taken"] for r in plan) == sum(len(WORD.findall(r["text"])) for r in out)
    cut = 0
    for r in out:
        assert any(r["text"] in t for t in texts[r["doc_id"]]) and r["n_chars"] == len(r["text"]) and r["text"].strip()
        cut += r["text"] not in texts[r["doc_id"]]
    assert 0 < cut
    # A run inside a document ends at a block's edge or the last block's cut: within a text, few runs for its blocks.
    long = [r for r in plan if r["doc_id"] == 1000][0]
    assert len(long["runs"]) <= 60_000 / mixing.BLOCK + 2
    assert all(a["end"] < b["begin"] for r in plan for a, b in zip(r["runs"], r["runs"][1:]))
    assert sum(b["end"] - b["begin"] < mixing.BLOCK // 2 for b in long["runs"]) <= 3
    for s in {r["source"] for r in plan}:
        own = [r for r in plan if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2


def test_seed_draws_other_blocks(spark):
    _, docs = table(spark)
    taken = lambda seed: {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix_sources(docs, seed=seed).collect()}
    assert taken(1) == taken(1) != taken(2)


@pytest.mark.parametrize("call", ["mix_sources", "mixed_texts"])
def test_columns_of_any_name_pass_through(spark, call):
    _, docs = table(spark, 30)
    wide = docs.selectExpr("*", *[f"concat('{c}', coalesce(cast(doc_id as string), 'none')) as `{c}`" for c in [*NAMES, "a.b", "with space"]])
    out = getattr(mixing, call)(wide)
    names = [c for c in NAMES if call == "mixed_texts" or c not in mixing.NEW] + ["a.b", "with space"]
    assert set(wide.columns) <= set(out.columns)
    for r in out.collect():
        assert all(r[c] == f"{c}{'none' if r['doc_id'] is None else r['doc_id']}" for c in names)
    assert out.count() > 0 and getattr(mixing, call)(wide.limit(0)).count() == 0
