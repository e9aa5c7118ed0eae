"""How far the sources of a language differ in their words: L1 distances of smoothed shares, exact in whole numbers.

A task takes its texts as Arrow arrays (ascii_lower, split_pattern_regex, dictionary_encode, hash group_by) and passes on
partial counts by language, source and term, with the number of documents. Spark sums them, keeps the terms of a language
that enough of its documents hold, and deals what is kept to shards of terms. A shard is a few columns; it gives the
distances of all pairs of sources as far as its terms go, and these add up. Where a language has many sources, a shard
meets two blocks of SOURCES of them at a time.

A term that neither source of a pair holds adds the same to the pair's distance whatever the term, so shards only hold
terms that one of their sources has, and the rest is a product.

Defined results: null text, lang or source is ''; repeated rows and rows that share an id are documents each; a group
without kept terms has the share that smoothing gives; a language without any kept term has distances of 0 and no terms; a
language with one source has no pairs; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.pieces import blocks, partial_counts
from tidemark.llm.shared import stored

#: A term is a run of ASCII letters and of characters outside ASCII; these part them.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
BREAK = re.compile(BETWEEN)
#: Documents of a language that must hold a term; occurrences added to each term; what shares are whole parts of; ranks listed.
LEAST, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Rows of a shard, about; sources that meet at a time; cells of the matrix that a shard fills at a time.
ROWS, SOURCES, CELLS = 1 << 15, 256, 1 << 20


def terms(texts: pa.Array, rows: np.ndarray) -> pa.Table:
    """(row, term, n) of lower-cased terms."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BETWEEN)
    term, row = pc.list_flatten(lists), pa.array(rows).take(pc.list_parent_indices(lists))
    real = pc.not_equal(term, "")
    coded = term.filter(real).dictionary_encode()
    found = pa.table({"row": row.filter(real), "code": coded.indices}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    return pa.table({"row": found["row"], "term": coded.dictionary.take(found["code"]), "n": found["count_all"]})


def counts_of_batch(batch: pa.RecordBatch, size: int) -> Iterator[pa.Table]:
    """(lang, source, term, n, docs) of the batch's documents, by block."""
    lang, source, text = (batch.column(c) for c in ("lang", "source", "text"))
    for start, end, parts in blocks(text, BREAK, size):
        found = [terms(*part) for part in parts]
        each = pa.concat_tables(found)
        if len(found) > 1:
            each = each.group_by(["row", "term"], use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
        names = pa.table({"lang": lang.slice(start, end - start), "source": source.slice(start, end - start)}).take(each["row"])
        coded = each["term"].combine_chunks().dictionary_encode()
        table = pa.table({"lang": names["lang"], "source": names["source"], "code": coded.indices, "n": each["n"]})
        table = table.group_by(["lang", "source", "code"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
        yield pa.table({"lang": table["lang"], "source": table["source"], "term": coded.dictionary.take(table["code"]), "n": table["n_sum"], "docs": table["count_all"]})


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * kinds)), exact; null where nothing is kept."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (count + ADDED).cast("decimal(20,0)")
    parts = F.when(kinds > 0, (total + ADDED * kinds).cast("decimal(20,0)"))
    return (F.call_function("div", whole, parts) + 1).cast("long")


def gaps(key: tuple[pa.Scalar, ...], table: pa.Table, together: int, most: int) -> pa.Table:
    """(lang, a, b, gap): for the sources a < b of two blocks, the sum over this shard's terms of |p - p'| - |base - base'|.

    together: sources of a block; most: cells that are filled at a time.
    """
    lang, left, right = (k.as_py() for k in key[:3])
    table = table.combine_chunks()
    idx, p = table["idx"].to_numpy(), table["p"].to_numpy()
    code = pc.fill_null(pc.cast(table["term"].combine_chunks().dictionary_encode().indices, pa.int64()), -1).to_numpy(zero_copy_only=False)
    none = code < 0  # a row for each source, with its share of a term it doesn't hold
    order = np.argsort(idx[none])
    who, base = idx[none][order], p[none][order]
    a, b = np.flatnonzero(who // together == left), np.flatnonzero(who // together == right)
    code, at, p = code[~none], np.searchsorted(who, idx[~none]), p[~none]
    order = np.argsort(code, kind="stable")
    code, at, p = code[order], at[order], p[order]
    out = np.zeros((len(a), len(b)), np.int64)
    step, kinds = max(1, most // max(1, len(who))), int(code[-1]) + 1 if len(code) else 0
    for low in range(0, kinds, step):
        own = slice(np.searchsorted(code, low), np.searchsorted(code, low + step))
        k = min(step, kinds - low)
        cells = np.tile(base, (k, 1))
        cells[code[own] - low, at[own]] = p[own]
        theirs = cells[:, b]
        for i, x in enumerate(a):
            out[i] += np.abs(theirs - cells[:, x : x + 1]).sum(axis=0) - k * np.abs(base[b] - base[x])
    i, j = np.nonzero(who[a][:, None] < who[b][None, :])
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "a": who[a][i].astype(np.int32), "b": who[b][j].astype(np.int32), "gap": out[i, j]})


def source_divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text, ...): distances of sources, and each source's own terms.

    Part pair: every other source of the language, by distance. Part term: the `top` terms whose share in the source is
    furthest above that in the language.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = partial_counts(plain, counts_of_batch, ["lang", "source", "term"], ["n", "docs"], "lang string, source string, term string, n long, docs long")
    counts = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    alike = Window.partitionBy("lang", "term")  # as many rows as the language has sources
    counts = counts.withColumn("_docs", F.sum("docs").over(alike)).withColumn("all", F.sum("n").over(alike)).withColumn("one", (F.row_number().over(alike.orderBy("source")) == 1).cast("long"))
    kept = stored(counts.where(F.col("_docs") >= least).select("lang", "source", "term", "n", "all", "one"), "divergence")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("one").alias("kinds"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    line = Window.partitionBy("lang").orderBy("source")
    groups = groups.withColumn("idx", F.row_number().over(line) - 1).withColumn("base", share(F.lit(0), F.col("total"), F.col("kinds")))
    groups = stored(groups, "divergence")  # a row for each (lang, source)
    found = kept.join(groups, ["lang", "source"]).select("lang", "source", "idx", "term", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"), share(F.col("all"), F.col("lang_total"), F.col("kinds")).alias("q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = found.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return own.unionByName(distances(kept, groups, found).withColumn("rank", F.row_number().over(best)))


def distances(kept: DataFrame, groups: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of each source beside each other one of its language."""
    shards, together, most = max(1, -(-kept.count() // ROWS)), SOURCES, CELLS
    rows = found.select("lang", "idx", "term", "p", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"))
    absent = groups.where("kinds > 0").select("lang", "idx", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    last = groups.groupBy("lang").agg(F.floor(F.max("idx") / together).alias("last"))
    block = F.floor(F.col("idx") / together)
    rows = rows.unionByName(absent).join(last, "lang").withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    rows = rows.select("lang", F.least(block, "met").alias("left"), F.greatest(block, "met").alias("right"), "shard", "idx", "term", "p")
    sums = rows.groupBy("lang", "left", "right", "shard").applyInArrow(lambda key, shard: gaps(key, shard, together, most), "lang string, a int, b int, gap long").groupBy("lang", "a", "b").agg(F.sum("gap").alias("gap"))
    x = groups.select("lang", "source", F.col("idx").alias("i"), F.col("base").alias("mine"), "kinds")
    y = groups.select("lang", F.col("source").alias("item"), F.col("idx").alias("j"), F.col("base").alias("theirs"))
    pairs = x.join(y, "lang").where("i <> j").withColumn("a", F.least("i", "j")).withColumn("b", F.greatest("i", "j")).join(sums, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("kinds") * F.abs(F.col("mine") - F.col("theirs")), F.lit(0)) + F.coalesce("gap", F.lit(0))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
