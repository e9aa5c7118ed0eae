"""Spelling variants of words: pairs one edit apart by asymmetric q-chunks, and each word's more frequent form.

Of a pair one edit apart, the shorter word (or the lesser of two equally long) gives two disjoint chunks, its first and its
last q code points, q being half its length. One edit leaves one of them whole: the first at its own place, the last moved
by the difference of the lengths. The other word gives its positional grams: of all its grams of q code points only those
at such places, at most one further right, can meet a chunk, so only they are made. What a whole chunk leaves of the word
holds the edit, and is cut in the same way again: one of its halves is whole too. A key is a whole chunk with a whole half
of the rest, so that it holds three quarters of a word and few words share it; equal keys meet in one join, and
each pair that meets is verified by its edit distance.

Words are counted by Arrow functions inside tasks before anything is shuffled, so a frequent word is a row a task. Forms
are followed by doubling: along forms n grows by the factor at least, so that STEPS rounds reach the end of any chain.

Defined results: null or empty text has no runs; a run of a row without an id is never damaged by the hash; rows that
repeat or share an id count as rows each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pieces import blocks, partial_counts
from tidemark.llm.shared import stored

#: What parts runs of letters; places a long text may be cut at.
BETWEEN = r"[^A-Za-z\x{C0}-\x{FF}]+"
BREAK = re.compile(r"[^A-Za-zÀ-ÿ]")
#: Code points and occurrences a word has at least; how much more frequent a form is; one run in so many loses a code point.
LEAST, OFTEN, FACTOR, DAMAGED = 6, 5, 5, 199
#: 5 ** 32 is more than any n: five doublings follow any chain.
STEPS = 5


def runs(texts: pa.Array, rows: np.ndarray) -> pa.Table:
    """(row, run, n) of the texts' lower-cased runs of at least LEAST letters."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BETWEEN)
    run, row = pc.list_flatten(lists), pa.array(rows).take(pc.list_parent_indices(lists))
    long = pc.greater_equal(pc.utf8_length(run), LEAST)
    coded = run.filter(long).dictionary_encode()
    found = pa.table({"row": row.filter(long), "code": coded.indices}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    return pa.table({"row": found["row"], "run": coded.dictionary.take(found["code"]), "n": found["count_all"]})


def counts_of_batch(batch: pa.RecordBatch, size: int) -> Iterator[pa.Table]:
    """(word, n) of the batch's documents, by block: runs, less a code point where the hash of id and run says so."""
    ids = [None if x is None else zlib.crc32(f"{x}:".encode()) for x in batch.column("doc_id").to_pylist()]
    for start, _, parts in blocks(batch.column("text"), BREAK, size):
        for part in parts:
            found = runs(*part)
            words = found["run"].to_pylist()
            for i, (row, word) in enumerate(zip(found["row"].to_pylist(), words, strict=True)):
                if (begun := ids[start + row]) is not None and (h := zlib.crc32(word.encode(), begun)) % DAMAGED == 0:
                    words[i] = word[: (at := h % len(word))] + word[at + 1 :]
            yield pa.table({"word": pa.array(words, pa.string()), "n": found["n"]}).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of docs (doc_id, text, ...)."""
    plain = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = partial_counts(plain, counts_of_batch, ["word"], ["n"], "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where((F.length("word") >= LEAST) & (F.col("n") >= OFTEN))


def keys(word: str, length: Column, short: Column) -> Column:
    """The keys a word of `length` shares with one of length `short`, this or one less, one edit from it; its own where both are one."""
    q = F.floor(short / 2).cast("int")
    half = F.floor((short - q) / 2).cast("int")
    part = lambda at, n: F.substring(F.col(word), at + 1, n)
    first, last = part(F.lit(0), q), part(length - q, q)
    rest = length - q  # of the word: what the first chunk leaves, or the last
    chosen = [(first, part(q, half)), (first, part(length - half, half)), (last, part(F.lit(0), half)), (last, part(rest - half, half))]
    return F.array(*[F.xxhash64(F.lit(i), short, chunk, more) for i, (chunk, more) in enumerate(chosen)])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of different words of words (word, n) that are exactly one edit apart, once each."""
    length = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(keys("word", length, length)).alias("key"))
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(F.concat(keys("word", length, length), keys("word", length, length - 1))).alias("key"))
    met = chunks.join(grams, "key").where((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs (doc_id, text, ...)."""
    found = stored(words(docs), "spelling")
    pairs = stored(near_pairs(found), "spelling")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best"))
    out = found.join(best, "word", "left")
    more = -F.col("best.less") >= FACTOR * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(more, F.col("best.form")).alias("form"), F.when(more, -F.col("best.less")).alias("form_n"))
    out = stored(out, "spelling")
    roots = out.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(STEPS):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling")
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
