"""Language of a text by error-correcting output codes over character n-grams.

Every learned language has a codeword; each bit of it is a binary classifier that adds the log-odds of hashed letter
trigrams. Decoding is loss-weighted: a language's loss sums log(1 + exp(-bit * margin)) over the bits, the least loss
wins, and a text whose best two losses hardly differ is flagged as ambiguous. With few languages all ways to split them
in two are bits; with many, a fixed pseudo-random choice of 12 bits a doubling.

Counts are learned from whole texts of a hash sample of labelled documents, SAMPLE an expected language at most (all
where there are fewer), of the LANGS most frequent values of lang (ties to the one that sorts first): a bound of the fit,
so that a lang column of free text fills neither driver nor plan. Everything else covers all rows and whole texts.

Defined results: null text, and text without a letter, is `und` with score 0; ties go to the language that sorts first;
if no row is labelled all is `und`; repeated rows are predicted each on its own; other columns pass through unchanged,
null or large ids included (those named lang_pred, score or ambiguous are replaced, by accepted kept), and lang, source and
doc_id never enter a prediction; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import made_of_text

#: Labelled texts a language and languages (the most frequent ones) learned from at most, buckets of trigrams, smoothing.
SAMPLE, LANGS, BUCKETS, SMOOTH = 2000, 256, 1 << 14, 0.5
#: Trigrams that count in full towards a margin; gap of losses below which a text is ambiguous; bytes read at a time.
EVIDENCE, GAP, CHUNK = 40, 0.05, 1 << 20
LETTER = re.compile(r"[^\W\d_]")
#: Lower case ASCII letters and bytes of other characters as they are, all else as a space.
FOLD = np.full(256, 32, np.uint32)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of some texts at a time: how many, the trigram bucket at each byte, and where each text's begin."""
    some, size = [], 0
    for text in [*texts, None]:
        if text is not None:
            some.append(text.lower().encode())
            size += len(some[-1]) + 3
        if some and (text is None or size >= CHUNK):
            a = FOLD[np.frombuffer(b"  " + b"   ".join(some) + b"   ", np.uint8)]
            code = a[:-2] << 16 | a[1:-1] << 8 | a[2:]
            bucket = np.where(code == 0x202020, BUCKETS, (code * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int32)
            ends = np.cumsum([len(t) + 3 for t in some])
            yield len(some), bucket, np.r_[0, ends[:-1]]
            some, size = [], 0


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1; no two alike, no column all one."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = np.arange(1, 2 ** (n - 1))
        return np.where(splits[None, :] >> np.arange(n)[:, None] & 1, 1.0, -1.0)
    bits = np.random.default_rng(n).choice([-1.0, 1.0], (n, 12 * int(np.ceil(np.log2(n)))))
    return bits[:, np.abs(bits.sum(axis=0)) < n]


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, weights of each bucket for each bit) from labelled (doc_id, text, lang)."""
    counted = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGS)
    rates = {r["lang"]: r["n"] for r in counted.collect()}
    langs = sorted(rates)
    if not langs:
        return [], np.zeros((BUCKETS + 1, 1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, SAMPLE / rates[lang]))])
    chosen = F.coalesce(draw < share[F.col("lang")], F.lit(False))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                total = np.zeros(BUCKETS + 1, np.int64)
                for _, bucket, _ in grams(own["text"].tolist()):
                    total += np.bincount(bucket, minlength=BUCKETS + 1)
                seen = np.flatnonzero(total[:BUCKETS])
                yield pd.DataFrame({"lang": lang, "bucket": seen, "n": total[seen]})

    sample = labelled.where(chosen & F.col("text").isNotNull()).select("lang", "text")
    found = sample.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), BUCKETS))
    counts[np.searchsorted(np.array(langs, object), found["lang"].to_numpy(object)), found["bucket"].to_numpy(np.int64)] = found["n"]
    share = (counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    code = codewords(len(langs))
    weights = np.zeros((BUCKETS + 1, code.shape[1]))
    for bit in range(code.shape[1]):
        yes, no = code[:, bit] > 0, code[:, bit] < 0
        if yes.any() and no.any():
            weights[:BUCKETS, bit] = np.log(share[yes].mean(axis=0)) - np.log(share[no].mean(axis=0))
    return langs, weights


def margins(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Each text's margin for each bit: its trigrams' mean log-odds times the evidence, EVIDENCE trigrams at most."""
    w = np.concatenate([weights, (np.arange(len(weights)) < BUCKETS)[:, None]], axis=1).astype(np.float32)
    out = []
    for n, bucket, starts in grams(texts):
        sums = np.zeros((n, w.shape[1]))
        edges = np.r_[starts, len(bucket)]
        for at in range(0, len(bucket), 1 << 17):  # bounded: a gathered row a byte
            part = w[bucket[at : at + (1 << 17)]]
            first = np.searchsorted(edges, at, "right") - 1
            cut = edges[first : np.searchsorted(edges, at + len(part), "left")] - at
            sums[first : first + len(cut)] += np.add.reduceat(part, np.maximum(cut, 0), axis=0, dtype=np.float64)
        seen = np.maximum(sums[:, -1:], 1)
        out.append(sums[:, :-1] / seen * np.minimum(seen, EVIDENCE))
    return np.concatenate(out) if out else np.zeros((0, weights.shape[1]))


def decode(margin: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, score 0 to 1, and whether the runner-up is about as near."""
    loss = np.logaddexp(0, -margin[:, None, :] * code[None, :, :]).sum(axis=2)
    best = loss.argmin(axis=1)
    p = np.exp(loss.min(axis=1, keepdims=True) - loss)
    score = 1 / p.sum(axis=1)
    two = np.sort(loss, axis=1)[:, :2]
    near = two[:, -1] - two[:, 0] < GAP if code.shape[0] > 1 else np.zeros(len(best), bool)
    return best, score, near


def with_language(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """docs (text, ...) with lang_pred, score and ambiguous, learned from labelled (doc_id, text, lang)."""
    langs, weights = learn(labelled.where("lang is not null"))
    code = codewords(len(langs))

    def make(texts: list[str | None]) -> dict[str, np.ndarray]:
        known = np.array([bool(langs) and t is not None and LETTER.search(t) is not None for t in texts], bool)
        pred, score, near = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
        if known.any():
            best, score[known], near[known] = decode(margins([t for t, k in zip(texts, known, strict=True) if k], weights), code)
            pred[known] = np.array(langs, object)[best]
        return {"lang_pred": pred, "score": score, "ambiguous": near}

    new = {"lang_pred": (T.StringType(), pa.string()), "score": (T.DoubleType(), pa.float64()), "ambiguous": (T.BooleanType(), pa.bool_())}
    return made_of_text(docs, new, make)


def remainder(doc_id: str, n: int) -> F.Column:
    """CRC-32 of doc_id as text, modulo n; a null doc_id counts as the empty text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % n


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language can be told: neither `und` nor ambiguous. Columns as they were.

    The classifier learns from the documents' own lang column.
    """
    # Whatever docs' other columns are called, they travel as one struct beside the text.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")
    found = with_language(whole, docs.select("doc_id", "text", "lang")).where("lang_pred <> 'und' and not ambiguous")
    return found.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
