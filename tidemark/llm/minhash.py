"""Near-duplicate documents by min-max hashing of word shingles, confirmed on full shingle sets.

Of each permutation both the least and the greatest value are kept, so a signature of 2p values costs p hash evaluations;
each value agrees with the set's resemblance as its probability. Bands of four values propose candidates. Documents with
equal sets are one class before anything else, so exact copies cost nothing. In a band's bucket every class is compared
with one hub, the class that meets most others (linear however large the bucket). A bucket that is then still in more
than one component is searched for links between them: its stragglers, the classes outside its largest component, are
compared with all of it, in blocks of bounded size that count common shingles by their postings; of the links of a
straggler to a component one is enough. Sets whose sizes differ by more than the share allows can't be linked and don't meet.
All links are confirmed as 100 * intersection >= 75 * union on full sets.

Defined results: null, empty and wordless texts have no shingle and are linked with nothing; with fewer words than a
shingle has, the whole sequence is the one shingle; doc_id is the key: rows that share one are one vertex, whose links
are those of all their texts, and a null doc_id is linked with nothing, has a null component and is kept; other columns are
ignored; an empty table gives none. deduplicated keeps one row of each group, repeated rows and null ids included.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import components, let_go, made_of_text, one_vertex, runs, stored

BANDS, ROWS = 24, 4
#: Stragglers and classes of a bucket that meet in one block; counted pairs of shingles, rows with sets at a time.
LEFT, RIGHT, PAIRS, BATCH = 256, 512, 1 << 20, 512
#: Bytes of text hashed at a time.
CHUNK = 1 << 20
_random = np.random.default_rng(20240229)
BYTE = _random.integers(0, 2**64, 256, np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
PLACE = _random.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
MUL = _random.integers(0, 2**64, BANDS * ROWS // 2, np.uint64) | np.uint64(1)
ADD = _random.integers(0, 2**64, BANDS * ROWS // 2, np.uint64)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word (bytes outside ASCII white space) of lower-cased text."""
    a = np.frombuffer(data, np.uint8)
    inside = ~SPACES[a]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    powers = np.cumprod(np.full(int(lengths.max()), STEP, np.uint64))
    letters = a[inside]
    firsts = np.cumsum(lengths) - lengths
    at = np.arange(len(letters)) - np.repeat(firsts, lengths)
    return mixed(np.add.reduceat(BYTE[letters] * powers[at], firsts) + lengths.astype(np.uint64)), starts


def shingle_sets(texts: list[str | None], k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles (A-Z lower-cased)."""
    some: list[bytes] = []
    size = 0
    for text in texts:
        some.append((text or "").encode().lower())
        size += len(some[-1])
        if size >= CHUNK:
            yield from _sets(some, k)
            some, size = [], 0
    yield from _sets(some, k)


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    words, starts = word_hashes(b"\n".join(texts))
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    cuts = np.searchsorted(starts, edges)
    n = len(words)
    full = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k if len(full) else 0):
        full += words[i : n - k + 1 + i] * PLACE[i]
    full = mixed(full)
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a >= k:
            yield np.unique(full[a : b - k + 1])
        elif b > a:
            yield mixed(np.array([(words[a:b] * PLACE[k : k + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)]))
        else:
            yield full[:0]


def bands(shingles: np.ndarray) -> np.ndarray:
    """Keys of the bands of a set's min-max signature."""
    low, high = [], []
    for at in range(0, len(shingles), 4096):
        v = shingles[None, at : at + 4096] * MUL[:, None] + ADD[:, None]
        low.append(v.min(axis=1))
        high.append(v.max(axis=1))
    signature = np.stack([np.min(low, axis=0), np.max(high, axis=0)], axis=1).reshape(BANDS, ROWS)
    return mixed((signature * PLACE[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * STEP).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of docs (doc_id, text)."""

    def make(texts: list[str | None]) -> dict[str, list]:
        rows = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, bands(s) if len(s) else None) for s in shingle_sets(texts)]
        return {c: [r[i] for r in rows] for i, c in enumerate(new)}

    new = {"n_shingles": (T.LongType(), pa.int64()), "set_key": (T.BinaryType(), pa.binary()), "bands": (T.ArrayType(T.LongType()), pa.list_(pa.int64()))}
    return made_of_text(docs.select("doc_id", "text"), new, make).drop("text")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the docs with some ids, shingles as bytes of sorted 64-bit hashes."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["doc_id"], "shingles": [s.tobytes() for s in shingle_sets(batch["text"].tolist())]})
        let_go()

    chosen = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    return stored(chosen.mapInPandas(sets, "id long, shingles binary"), "near-sets", BATCH)


def confirmed(docs: DataFrame, pairs: DataFrame, share: int = 75) -> DataFrame:
    """Those of pairs (a, b of doc_id) whose full shingle sets resemble each other enough."""
    chosen = full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                most = min(len(x), len(y))
                if 100 * most < share * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= share * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]
        let_go()

    both = pairs.join(chosen.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(chosen.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInPandas(check, "a long, b long"), "near-links", BATCH)


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left and right sets, from the postings of their shingles."""
    x, y = np.concatenate(left), np.concatenate(right)
    own, other = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    order = np.argsort(y, kind="stable")
    y, other = y[order], other[order]
    low = np.searchsorted(y, x, "left")
    n = np.searchsorted(y, x, "right") - low
    own, low, n = own[n > 0], low[n > 0], n[n > 0]
    out = np.zeros(len(left) * len(right), np.int64)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS)))
        k = n[at:to]
        place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[at:to], k)
        out += np.bincount(np.repeat(own[at:to], k) * len(right) + other[place], minlength=len(out))
        at = to
    return out.reshape(len(left), len(right))


def across(docs: DataFrame, shared: DataFrame, found: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between different components of a bucket. shared: (band, id, n_shingles); found: components so far."""
    rows = shared.join(found, "id", "left").select("band", "id", "n_shingles", F.coalesce("component_id", "id").alias("c"))
    # Sets that can be linked lie in the same class of sizes or in neighbouring ones; a pair meets where its smaller set's class does.
    size = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / share) + 1e-9).cast("int")
    filed = F.array(F.struct(size.alias("size"), F.lit(True).alias("home")), F.struct((size - 1).alias("size"), F.lit(False).alias("home")))
    rows = rows.withColumn("filed", F.explode(filed)).select(F.xxhash64("band", "filed.size").alias("band"), "id", "c", "filed.home")
    rows = stored(rows, "near-open")
    sizes = rows.groupBy("band", "c").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("home"))
    buckets = sizes.groupBy("band").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max("home").alias("home")).where("n > most and home")
    chunks = lambda n, size: F.ceil(n / size).cast("int")
    rows = rows.join(buckets.select("band", "main", chunks(F.col("n"), RIGHT).alias("kr"), chunks(F.col("n") - F.col("most"), LEFT).alias("kl")), "band")
    chunk = lambda k: F.pmod(F.xxhash64("id", F.lit(23)), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    right = rows.select("band", "id", "c", F.lit(False).alias("straggler"), every("kl").alias("l"), chunk("kr").alias("r"))
    left = rows.where("c <> main").select("band", "id", "c", F.lit(True).alias("straggler"), chunk("kl").alias("l"), every("kr").alias("r"))
    dealt = stored(left.unionByName(right), "near-blocks")
    sets = full_sets(docs, dealt.select(F.col("id").alias("doc_id")).distinct())
    blocks = dealt.join(sets, "id").repartition("band", "l", "r").sortWithinPartitions("band", "l", "r")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in runs(batches, ["band", "l", "r"]):
            keys = batch[["band", "l", "r"]].to_numpy()
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
            out = []
            for at, end in zip(edges, edges[1:], strict=False):
                block = batch.iloc[at:end]
                one, two = block[block["straggler"]], block[~block["straggler"]]
                if not len(one) or not len(two):
                    continue
                x, y = ([np.frombuffer(v, np.uint64) for v in part["shingles"]] for part in (one, two))
                both = common(x, y)
                sizes = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None, :]
                c = two["c"].to_numpy()
                hit = (100 * both >= share * (sizes - both)) & (one["c"].to_numpy()[:, None] != c[None, :])
                i, j = np.nonzero(hit)
                if len(i):
                    links = pd.DataFrame({"a": one["id"].to_numpy()[i], "b": two["id"].to_numpy()[j], "c": c[j]})
                    out.append(links.drop_duplicates(["a", "c"])[["a", "b"]])
            if out:
                yield pd.concat(out)
        let_go()

    return stored(blocks.select("band", "id", "c", "straggler", "l", "r", "shingles").mapInPandas(search, "a long, b long"), "near-links", BATCH)


def near_duplicates(docs: DataFrame, share: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text, ...)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = stored(signatures(docs), "near-rows", 4 * BATCH)
    named = rows.where("n_shingles > 0 and doc_id is not null")
    classes = stored(named.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n")), "near-classes")
    entries = classes.select("id", "n_shingles", F.explode("bands").alias("band"))
    met = entries.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(entries.join(met, "band"), "near-buckets")
    central = shared.groupBy("id").agg(F.sum("n").alias("met"))
    ranked = shared.join(central, "id")
    hubs = ranked.groupBy("band").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("hub"))
    star = shared.join(hubs, "band").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    texts = docs.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    links = confirmed(texts, stored(star, "near-pairs"), share)
    found = components(links, "near-components")
    links = links.unionByName(across(texts, shared.select("band", "id", "n_shingles"), found, share))
    links, several = one_vertex(links, rows.select(F.col("doc_id").alias("id"), "set_key"), classes.select("set_key", F.col("id").alias("first")), "set_key", "near")
    found = components(links, "near-components")
    copies = classes.where("n > 1").select("set_key", F.col("id").alias("first"))
    out = rows.join(copies, "set_key", "left").join(several, rows["doc_id"] == several["id"], "left").drop("id")
    out = out.withColumn("id", F.coalesce("vertex", "first", "doc_id")).join(found, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, share: int = 75) -> DataFrame:
    """One row of docs of each group of near duplicates: one with the smallest doc_id.

    A null doc_id is larger than any other; for the search its row has a place of its own by a hash of all columns, beyond
    2^62, where ids are asked not to lie. Of repeated rows one stays; of other rows that share an id, which are one vertex,
    the first by text and then by hash. Columns of any name and type but maps pass through.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key, first = (f"_{name}" + "_" * max(map(len, docs.columns)) for name in ("place", "first"))  # longer than any name there is
    place = F.shiftrightunsigned(F.xxhash64(*columns), 2).bitwiseOR(F.lit(1 << 62))
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), place))
    found = stored(near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), share), "near-found")
    gone = found.where("not kept").select(F.col("doc_id").alias(key)).distinct()
    again = found.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(key))
    left = rows.join(gone, key, "left_anti")
    line = Window.partitionBy(key).orderBy("text", F.xxhash64(*columns))
    several = left.join(again, key, "left_semi").dropDuplicates().withColumn(first, F.row_number().over(line)).where(F.col(first) == 1)
    return left.join(again, key, "left_anti").select(*columns).unionByName(several.select(*columns))
