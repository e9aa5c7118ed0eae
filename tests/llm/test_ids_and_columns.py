"""Ids beside nulls, ids shared by rows, repeated rows, clashing columns, empty tables and very long texts: all operators and stages."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import langid, lattice, minhash, pii, quality, tokens
from tidemark.llm.queries import piece_model

NAMES = """lang_pred score ambiguous ids decoded spans base_sha256 n_email features predicted quality place bands set_key n_shingles component_id kept id row
    first vertex band c l r _place _first shingles hub met size source_size target taken times runs shard rank label x y n k draw window tags""".split()


def rows():
    rng = random.Random(3)
    words = {"aa": ["the", "house", "with", "thing", "over"], "bb": ["der", "haus", "mit", "ding", "fern"]}
    out = [(i, " ".join(rng.choices(words[k], k=40)) + " mail me at joe@example.com" * (i % 3 == 0), k, f"s{i % 2}", 1) for i, k in enumerate(["aa", "bb"] * 15)]
    big = 2**53 + 1
    out += [(None, "the house with thing " * 20, "aa", "s0", 1), (big, out[4][1] + " the", "aa", "s0", 1), (big + 2, None, None, None, None), (big + 4, "", "bb", "s0", 1)]
    out += [out[6], out[6], (7, "der haus ding " * 30, "bb", "s0", 1), (8, out[20][1], "aa", "s0", 1), (None, "the house with thing " * 20, "aa", "s0", 1), (None, None, "aa", "s0", 1), (50, "over " * 400_000, "aa", "s1", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.selectExpr("*", *[f"concat('{c}', coalesce(cast(doc_id as string), 'none')) as `{c}`" for c in NAMES])


def ids(df):
    return collections.Counter(r[0] for r in df.select("doc_id").collect())


def test_operators_keep_every_id(docs):
    want = collections.Counter(r[0] for r in rows())
    labels = docs.select("doc_id", (F.length("text") % 2).alias("quality"), F.lit("x").alias("text"), F.lit(1).alias("score"))
    for out in (tokens.with_digests(docs, piece_model()), langid.with_language(docs, docs.select("doc_id", "text", "lang")), quality.scored(docs, labels, F.lit(True)), pii.with_spans(docs), minhash.near_duplicates(docs)):
        assert ids(out) == want, out.columns
    none = docs.limit(0)
    for out in (tokens.with_digests(none, piece_model()), langid.with_language(none, none), quality.scored(none, labels, F.lit(True)), pii.with_spans(none), minhash.near_duplicates(none), minhash.deduplicated(none), langid.accepted(none)):
        assert out.count() == 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_ids_and_columns(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, "")
    # 2^53 + 1 is a near copy of 4.
    assert set(ids(out)) <= {r[0] for r in rows()} and (2**53 + 1 in ids(out)) == (name != "near_duplicates")
    assert stage(spark, docs.limit(0), "").count() == 0
    if name != "tokens":
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        for r in out.drop("text").collect():
            assert all(r[c] == f"{c}{'none' if r['doc_id'] is None else r['doc_id']}" for c in NAMES)


def test_one_row_of_each_group_stays(docs):
    kept = ids(minhash.deduplicated(docs))
    # 6 three times, 7 and 8 twice (8 holds a copy of 20 too); two rows without id hold one text, one holds none.
    assert kept[6] == 1 and kept[7] == 1 and kept[8] == 1 and kept[20] == 0 and kept[None] == 2 and kept[2**53 + 1] == 0 and kept[2**53 + 3] == 1
    again = ids(minhash.deduplicated(docs.repartition(5)))
    assert again == kept


def test_rows_that_share_an_id_are_one_vertex(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    out = minhash.near_duplicates(spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (9, c), (12, c), (5, ""), (20, "")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(3, 3), (5, 3), (9, 3), (12, 3), (20, 20)}
    vectors = [(3, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (7, [0.0, 1.0, 0.01]), (5, None), (8, [0.0, 0.0, 1.0])]
    out = lattice.cosine_links(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    assert {(r["vec_id"], r["component_id"]) for r in out} == {(3, 3), (5, 3), (7, 3), (8, 8)}


def test_a_threshold_that_needs_too_many_tables_is_refused():
    with pytest.raises(ValueError):
        lattice.tables(64, 2, 0.05, 1e-6)
