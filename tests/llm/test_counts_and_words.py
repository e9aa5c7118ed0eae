"""Token counts against the library, source divergence and spelling variants against plain versions, on small and odd tables."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import counts, divergence, pieces, spelling
from tidemark.llm.queries import piece_model, word_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, word string, n_tokens string"


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def odd_texts(seed, n):
    """Texts of all that a boundary could break: specials, marks that compose, signs, digits, all kinds of white space."""
    rng = random.Random(seed)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|end", "oftext|>", "'s", "'ll", "it's", "can't", "é", "́", "àb", "가", "K", "İ", "ΣΑΣ", "ß", "1", "42", "x9y", "²", "½", "=", "̸", "--", "|", "(a)", "ab|>", "don't", "O'Neil's", "🎉👍🏽", "\x00", "\x1c", "日本語", "ﬁ", "word", "Words", "a" * 30]
    spaces = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x85", "\xa0", " ", "　", "", "", ""]
    return ["".join(rng.choice(parts) + rng.choice(spaces) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def library_lengths(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(x) for x in model.encode(texts)]
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("small", [False, True])
def test_counts_equal_the_library(spark, monkeypatch, name, small):
    if small:  # everything is cut wherever it may be
        monkeypatch.setattr(counts, "LONG", 3)
        monkeypatch.setattr(counts, "BATCH", 50)
        monkeypatch.setattr(counts, "KNOWN", 2000)
    own = counts.Lengths(vocabulary(name))
    texts = odd_texts(7, 400)
    got = np.zeros(len(texts), np.int64)
    for start, end, parts in pieces.blocks(pa.array(texts, pa.string()), own.safe, 30 if small else pieces.BLOCK):
        for first, (part, rows) in enumerate(parts):
            cut = first and own.kind == "pieces"
            own.count(pa.array([x[1:] for x in part.to_pylist()], pa.string()) if cut else part, rows, got[start:end])
    assert got.tolist() == library_lengths(vocabulary(name), texts)
    assert own.kind == {"word_bpe_49k.json": "words", "byte_bpe_50k.json": "spaces", "piece_bpe_32k.model": "pieces"}[name]


def test_counts_of_megabytes():
    own = counts.Lengths(word_vocabulary())
    rng = random.Random(2)
    texts = ["ab1=" * 500_000, "words of a text, " * 120_000, "".join(rng.choices("abc déf1=|-", k=1_500_000)), "x" * 300_000, ""]
    got = np.zeros(len(texts), np.int64)
    for start, end, parts in pieces.blocks(pa.array(texts, pa.string()), own.safe):
        for part, rows in parts:
            own.count(part, rows, got[start:end])
    assert got.tolist() == library_lengths(word_vocabulary(), texts)
    assert sum(len(k) for k in own.known) < 1 << 22


def rows():
    rng = random.Random(5)
    base = ["colour", "kolour", "color", "colors", "colours", "collour", "banana", "bananas", "bannana", "straße", "strasse", "naïveté", "naivete", "Über×mut", "übermut"]
    out = [(i, " ".join(rng.choices(base, k=60)) + " Rare", ["en", "de", None][i % 3], f"s{i % 4}" if i % 5 else None, 1, "x", "y", "z") for i in range(150)]
    out += [(None, "colour colour banana", "en", "s0", 1, None, None, None), (900, None, "en", "s0", None, None, None, None), (901, "", "fr", "s9", 1, "", "", ""), (902, "un seul", "fr", "s8", 1, "", "", "")]
    out += [out[4], out[4], (7, "banana, banana! COLOUR", "en", None, 1, "", "", ""), (903, "colour banana " * 30_000, "en", "s1", 1, "", "", "")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def is_letter(c):
    return "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ"


def plain_words(rows_):
    out = collections.Counter()
    for i, text, *_ in rows_:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for run in "".join(c if is_letter(c) else " " for c in low).split(" "):
            if run:
                h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
                out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(found):
    form, out = {}, {}
    for w, n in found.items():
        near = [x for x in found if x != w and one_edit(w, x)]
        best = min(near, key=lambda x: (-found[x], x), default=None)
        form[w] = best if best and found[best] >= 5 * n else None
        out[w] = (n, len(near))
    for w in found:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, *out[w], found.get(form[w])


@pytest.mark.parametrize("small", [False, True])
def test_variants_equal_a_plain_version(docs, monkeypatch, small):
    if small:
        monkeypatch.setattr(pieces, "BLOCK", 200)
        monkeypatch.setattr(pieces, "HELD", 8)
    got = sorted(map(tuple, spelling.spelling_variants(docs).collect()), key=str)
    assert got == sorted(plain_variants(plain_words(rows())), key=str) and len(got) > 10
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(9)
    found = {"".join(rng.choices("abé", k=rng.randint(6, 9))): rng.choice([5, 25, 125, 700]) for _ in range(700)}
    pairs = spelling.near_pairs(spark.createDataFrame(list(found.items()), "word string, n long")).collect()
    got = [frozenset((r["a"], r["b"])) for r in pairs]
    assert len(got) == len(set(got)) and set(got) == {frozenset((a, b)) for a in found for b in found if a < b and one_edit(a, b)}
    assert all(r["n_a"] == found[r["a"]] and r["n_b"] == found[r["b"]] for r in pairs)


def plain_divergence(rows_, least, top):
    held, total, groups = collections.defaultdict(set), collections.defaultdict(collections.Counter), set()
    for at, (_, text, lang, source, *_) in enumerate(rows_):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for term in "".join(c if c.isascii() and c.isalpha() or not c.isascii() else " " for c in low).split(" "):
            if term:
                held[lang, term].add(at)
                total[lang, source][term] += 1
    for lang, source in groups:
        own = [t for x, t in held if x == lang and len(held[x, t]) >= least]
        sides = [s for x, s in groups if x == lang]

        def share(counts, own=own):
            n = sum(counts[t] for t in own)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (n + 5 * len(own)) for t in own}

        p, q = share(total[lang, source]), share(sum((total[lang, s] for s in sides), collections.Counter()))
        far = sorted((-sum(abs(p[t] - x[t]) for t in own), s) for s in sides if s != source for x in [share(total[lang, s])])
        ranked = sorted((q[t] - p[t], t) for t in own if total[lang, source][t] and p[t] > q[t])
        for part, items in (("pair", far), ("term", ranked[:top])):
            yield from ((lang, source, part, item, -v, i + 1) for i, (v, item) in enumerate(items))


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_a_plain_version(docs, monkeypatch, small):
    if small:
        for name, value in (("ROWS", 5), ("SOURCES", 2), ("CELLS", 8)):
            monkeypatch.setattr(divergence, name, value)
        monkeypatch.setattr(pieces, "BLOCK", 100)
        monkeypatch.setattr(pieces, "HELD", 10)
    got = sorted(map(tuple, divergence.source_divergence(docs, 30, 4).collect()))
    assert got == sorted(plain_divergence(rows(), 30, 4))
    assert {r[2] for r in got} == {"pair", "term"} and any(r[0] == "fr" and r[4] == 0 for r in got)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_counts_of_odd_rows(spark, docs):
    out = counts.token_counts(docs, word_vocabulary())
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    texts = [r[1] or "" for r in rows()]
    want = sorted(((r[0], len(t.encode()), n, n > 2048) for r, t, n in zip(rows(), texts, library_lengths(word_vocabulary(), texts), strict=True)), key=str)
    assert sorted(map(tuple, out.collect()), key=str) == want
    wide = counts.with_counts(docs, piece_model(), 10)
    assert wide.columns == [*[c for c in docs.columns if c != "n_tokens"], "n_bytes", "n_tokens", "over_limit"] and wide.count() == len(rows())
    assert counts.token_counts(docs.limit(0), word_vocabulary()).count() == 0


def test_token_query_counts_whole_table(spark):
    from tidemark.llm.queries import QUERIES

    path = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    want = dict(zip(texts, library_lengths(word_vocabulary(), list(texts.values())), strict=True))
    got = QUERIES["op12_token_counts"](spark, path).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and all(r["n_bytes"] == len(texts[r["doc_id"]].encode()) for r in got)
