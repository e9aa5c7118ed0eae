"""Quality of a text by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text. Weights are learned from preference pairs (a document
labelled 1 beats one labelled 0) by logistic loss on feature differences; strengths are then placed so that the quantile
of the labelled strengths at the share of label 0 becomes the score `cut`, and squashed to 0..1.

Features are shares of kinds of characters, lengths and repetitions (NAMES), and words and character trigrams hashed to
HASHED buckets each, as square roots of their shares of a text. Scores cover all rows. Weights are fitted on SAMPLE labelled
rows at most, the first by a hash of doc_id.

Defined results: null text counts as empty text, which gets a score like any other; null labels are not learned from; if
only one label occurs, all score the cut; equal texts score equally; doc_id, lang, source and labels are no features;
doc_ids come back as they are, null, large or repeated; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.minhash import word_hashes
from tidemark.llm.shared import made_of_text

SAMPLE, PAIRS, STEPS, RIDGE, CUT = 20_000, 30_000, 400, 1e-4, 0.3
#: Buckets of words, and of character trigrams; bytes, and rows, of text at a time.
HASHED, CHUNK, ROWS = 256, 1 << 20, 2048
UPPER, LOWER, DIGIT, SPACE, LINE, STOP, MARK, OTHER = range(8)
CLASS = np.full(256, MARK, np.int64)
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[128:] = UPPER, LOWER, DIGIT, OTHER
CLASS[[9, 11, 12, 32]], CLASS[[10, 13]], CLASS[[44, 46]] = SPACE, LINE, STOP
NAMES = ["upper", "digit", "line", "stop", "mark", "other", "words", "word_length", "repeated", "repeated_2", "distinct", "heavy_mark", "heavy_repeat", "heavy_upper", "empty"]


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """A row of NAMES and hashed shares for each text."""
    some: list[bytes] = []
    size = 0
    for text in texts:
        some.append((text or "").encode())
        size += len(some[-1])
        if size >= CHUNK:
            yield _features(some)
            some, size = [], 0
    if some:
        yield _features(some)


def _features(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    data = b"\n".join(texts)
    lengths = np.array([len(t) for t in texts])
    edges = np.cumsum(np.r_[0, lengths + 1])
    owner = np.repeat(np.arange(n), lengths + 1)[: len(data)]
    kinds = np.bincount(owner * 8 + CLASS[np.frombuffer(data, np.uint8)], minlength=8 * n).reshape(n, 8).astype(float)
    kinds[:-1, LINE] -= 1  # the line ends between texts
    words, starts = word_hashes(data.lower())
    cuts = np.searchsorted(starts, edges)
    count = np.diff(cuts).astype(float)
    whose = np.repeat(np.arange(n), np.diff(cuts))
    again = lambda k: np.bincount(whose[k:][(words[k:] == words[:-k]) & (whose[k:] == whose[:-k])], minlength=n)
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)], float)
    letters = np.maximum(kinds[:, [UPPER, LOWER, OTHER]].sum(axis=1), 1)
    chars, w = np.maximum(lengths, 1), np.maximum(count, 1)
    upper, mark, same = kinds[:, UPPER] / letters, kinds[:, MARK] / chars, again(1) / w
    bucket = lambda x: (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64)
    shares = [np.bincount(whose * HASHED + bucket(words), minlength=n * HASHED).reshape(n, HASHED) / w[:, None]]
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    inner = np.flatnonzero(owner[2:] == owner[:-2]) if len(a) > 2 else np.zeros(0, np.int64)
    inner = inner[inner + 2 < edges[owner[inner] + 1] - 1]  # not with the line end between texts
    grams = a[inner] << np.uint64(16) | a[inner + 1] << np.uint64(8) | a[inner + 2]
    shares.append(np.bincount(owner[inner] * HASHED + bucket(grams), minlength=n * HASHED).reshape(n, HASHED) / np.maximum(lengths - 2, 1)[:, None])
    plain = np.stack(
        [upper, kinds[:, DIGIT] / chars, kinds[:, LINE] / chars, kinds[:, STOP] / chars, mark, kinds[:, OTHER] / chars, np.log1p(count) / 10, np.minimum(letters / w, 20) / 10, same, again(2) / w, distinct / w]
        + [np.minimum(mark / 0.02, 1), np.minimum(same / 0.1, 1), np.minimum(upper / 0.15, 1), (lengths == 0).astype(float)],
        axis=1,
    )
    return np.concatenate([plain, *[np.sqrt(s) for s in shares]], axis=1).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset: gradient descent with momentum on PAIRS preference pairs, each label's rows used evenly."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1]), np.log(CUT / (1 - CUT))
    rng = np.random.default_rng(7)
    pairs = max(PAIRS, len(x))
    scale = (x.std(axis=0) + 1e-6).astype(np.float32)
    # The many hashed shares together weigh about as much as a few of the others.
    scale[len(NAMES) :] = np.maximum(scale[len(NAMES) :], 1e-3) * (2 * HASHED / 4) ** 0.5
    d = (good[rng.permutation(pairs) % len(good)] - bad[rng.permutation(pairs) % len(bad)]) / scale
    w, v = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        v = np.float32(0.9) * v + (p @ d / np.float32(pairs) - np.float32(RIDGE) * w)
        w = w + np.float32(0.3) * v
    w = (w / scale).astype(np.float64)
    s = x @ w
    # Where the strengths of the two labels part: the quantile at the share of label 0.
    at = np.quantile(s, (y == 0).mean())
    return w, np.log(CUT / (1 - CUT)) - at


def with_features(docs: DataFrame) -> DataFrame:
    """docs (text, ...) with features, as bytes of 32-bit floats, in place of the text."""

    def make(texts: list[str | None]) -> dict[str, list]:
        return {"features": [row.tobytes() for part in features(texts) for row in part]}

    return made_of_text(docs, {"features": (T.BinaryType(), pa.binary())}, make, ROWS).drop("text")


def scored(docs: DataFrame, labels: DataFrame, learn: F.Column) -> DataFrame:
    """(doc_id, score, predicted) of docs (doc_id, text), fitted on labels (doc_id, quality) of the rows with `learn`."""
    marked = labels.where("quality in (0, 1)").select("doc_id", "quality")
    # Thinned by hash first: each partition sends its first rows to the driver, which would otherwise grow with their number.
    share = min(1.0, 1.25 * SAMPLE / max(marked.count(), 1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < int(share * (1 << 30))
    chosen = docs.select("doc_id", "text").where(learn & draw).join(marked.where(draw), "doc_id")
    chosen = with_features(chosen.select(F.xxhash64("doc_id", F.lit(5)).alias("place"), "doc_id", "quality", "text"))
    found = chosen.orderBy("place", "doc_id").limit(SAMPLE).select("features", "quality").collect()
    width = len(NAMES) + 2 * HASHED
    x = np.array([np.frombuffer(r["features"], np.float32) for r in found], np.float32).reshape(len(found), width)
    w, offset = fit(x, np.array([r["quality"] for r in found]))

    def make(texts: list[str | None]) -> dict[str, np.ndarray]:
        strength = [part.astype(np.float64) @ w + offset for part in features(texts)]
        return {"score": 1 / (1 + np.exp(-np.clip(np.concatenate(strength) if strength else np.zeros(0), -30, 30)))}

    rows = made_of_text(docs.select("doc_id", "text"), {"score": (T.DoubleType(), pa.float64())}, make, ROWS).drop("text")
    return rows.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
