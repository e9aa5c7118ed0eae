"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks (DataFrame functions only).

Targets share `share` times all words by weight; a source stops at `max_epochs` times its size and the excess goes to
the others by weight. A source is cut into shards of about SHARD_WORDS words by a hash of its documents, a shard's
documents lie end to end in a seeded order, and the shard is cut into equal blocks of about BLOCK words. Blocks are given
to sources by highest quotients target/(2k+1), and each source's blocks to its shards by highest quotients size/(2k+1), so
that quotas are whole numbers that sum exactly. In a shard a seeded order of the blocks says which are taken once more than
the others; what rounding to blocks leaves of the source's target is spread over its shards and cuts or lengthens the last
block that each takes. A document is thus taken whole wherever its blocks are, and otherwise in contiguous runs.

Defined results: null or wordless text has size 0 and nothing is taken; a null source is a source of its own, placed
last; a null doc_id is an ordinary document that hashes by its text; repeated rows are mixed each on its own; other
columns, whatever their names, pass through (those named as a new one are replaced by it in mix_sources and kept in
mixed_texts); an empty table gives an empty result. The catalogue of sources, and the shards of a source, of which there
are MOST_SHARDS at most, must fit one task's sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD, stored

#: Words of a block, words of a shard of a source, shards of a source at most (beyond, shards grow).
BLOCK, SHARD_WORDS, MOST_SHARDS = 512, 1 << 16, 1 << 24
NEW = ("size", "source_size", "target", "taken", "times", "runs")


def hashed(text: Column, part: int = 0) -> Column:
    """32 bits of the MD5 of a text, as long; the same on every engine."""
    return F.conv(F.substring(F.md5(text), 1 + 8 * part, 8), 16, 10).cast("long")


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def apportion(parties: DataFrame, group: list[str], order: str, votes: str, seats: str) -> DataFrame:
    """Sainte-Laguë: adds `won`, each party's seats by highest quotients votes/(2k+1) within its group, ties by `order`.

    The divisor method gives at most S (the number of parties) seats apart from exact shares, so all quotients that can
    be on either side of the last seat lie within share*(1 -+ S/seats) -+ 2 of each party; only those are ranked.
    """
    whole = Window.partitionBy(*group)
    p = parties.withColumn("_v", F.sum(votes).over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    share = F.when(F.col("_v") > 0, F.col(seats) * F.col(votes) / F.col("_v")).otherwise(0.0)
    slack = F.col("_n") / F.greatest(F.col(seats), F.lit(1))
    p = p.withColumn("_low", F.greatest(F.lit(0), F.floor(share * (1 - slack)) - 2).cast("long"))
    p = p.withColumn("_high", F.when(F.col(votes) > 0, (F.ceil(share * (1 + slack)) + 2).cast("long")).otherwise(F.lit(0)))
    p = p.withColumn("_open", F.col(seats) - F.sum("_low").over(whole))
    rows = p.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_high") - F.col("_low"))))
    rows = rows.withColumn("_q", F.when(F.col("_low") + F.col("_k") < F.col("_high"), F.col(votes) / (2 * (F.col("_low") + F.col("_k")) + 1)))
    best = Window.partitionBy(*group).orderBy(F.col("_q").desc_nulls_last(), F.col(order))
    rows = rows.withColumn("_won", (F.col("_q").isNotNull() & (F.row_number().over(best) <= F.col("_open"))).cast("long"))
    keep = parties.columns
    return rows.groupBy(*keep, "_low").agg(F.sum("_won").alias("_more")).select(*keep, (F.col("_low") + F.col("_more")).alias("won"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Adds rank, weight and target to (source, source_size): the level at which shares by weight meet the caps."""
    line = Window.orderBy(F.col("source").isNull(), "source")
    s = sources.withColumn("rank", F.row_number().over(line) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    total = F.lit(share) * F.sum("source_size").over(Window.partitionBy())
    below = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (total - below) / above)
    first = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "rank", "level")))
    level = first.over(Window.partitionBy())["level"]
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))).drop("cap", "level")


def mix_plan(docs: DataFrame, keep: list[str], weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: int = 0) -> DataFrame:
    """(row, size, source_size, target, taken, times, runs) of every row of docs (doc_id, text, source, ...).

    row: a struct of the columns to keep. The whole text is taken `times` times, and once more the runs of words
    (begin, end) of `runs`.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    facts = [F.col("source"), F.col("doc_id").alias("id"), words().alias("size"), hashed(key).alias("spot"), hashed(key, 1).alias("turn")]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.lit(None).alias("row")
    # Everything but the text decides the mix: that part is stored once and feeds the totals, and the rows if no text is kept.
    wide = "text" in keep
    facts_only = stored(docs.select(*facts, *([] if wide else [row])), "mix")
    rows = docs.select(*facts, row, F.xxhash64("text").alias("last")) if wide else facts_only.withColumn("last", F.lit(0))

    sources = targets(facts_only.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    seats = F.floor(F.sum("target").over(Window.partitionBy()) / BLOCK).cast("long")
    sources = apportion(sources.withColumn("seats", seats), [], "rank", "target", "seats").withColumnRenamed("won", "quota")
    shards = F.least(F.greatest(div(F.col("source_size") + SHARD_WORDS - 1, F.lit(SHARD_WORDS)), F.lit(1)), F.lit(MOST_SHARDS))
    sources = stored(sources.select(F.col("source").alias("of"), "rank", "source_size", "target", "quota", shards.alias("shards")), "mix")

    def dealt(some: DataFrame) -> DataFrame:
        found = some.join(sources.select("of", "rank", "shards"), some["source"].eqNullSafe(F.col("of")))
        return found.withColumn("shard", F.col("spot") % F.col("shards")).drop("source", "of", "shards", "spot")

    cells = dealt(facts_only).groupBy("rank", "shard").agg(F.sum("size").alias("cell_size"))
    cells = apportion(cells.join(sources.select("rank", "source_size", "target", "quota"), "rank"), ["rank"], "shard", "cell_size", "quota")
    cells = cells.withColumn("blocks", F.greatest(F.rint(F.col("cell_size") / BLOCK), F.lit(1.0)).cast("long"))
    cells = cells.withColumn("rough", div(F.least("won", max_epochs * F.col("blocks")) * F.col("cell_size"), F.col("blocks")))
    own = Window.partitionBy("rank")
    cells = cells.withColumn("gap", F.floor("target").cast("long") - F.sum("rough").over(own)).withColumn("n", F.count(F.lit(1)).over(own))
    cells = cells.withColumn("i", F.row_number().over(own.orderBy("shard")).cast("long"))
    even = div(F.col("gap") * F.col("i"), F.col("n")) - div(F.col("gap") * (F.col("i") - 1), F.col("n"))
    cells = cells.withColumn("wanted", F.greatest(F.lit(0), F.least(F.col("rough") + even, max_epochs * F.col("cell_size"))))
    size = F.greatest(F.col("cell_size"), F.lit(1))
    cells = cells.select("rank", "shard", "cell_size", "source_size", "target", "blocks", div(F.col("wanted"), size).alias("times"), (F.col("wanted") % size).alias("rest"))
    # How much of each block, from its beginning, is taken once more: all of the first ones in the seeded order, and part of one.
    each = cells.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.withColumn("length", edge(F.col("j") + 1) - edge(F.col("j")))
    line = Window.partitionBy("rank", "shard").orderBy(hashed(F.concat_ws(":", F.lit(seed), "rank", "shard", "j")), "j")
    before = F.coalesce(F.sum("length").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("more", F.greatest(F.lit(0), F.least(F.col("length"), F.col("rest") - before)))
    same = [F.first(c).alias(c) for c in ("cell_size", "source_size", "target", "blocks", "times")]
    more = F.transform(F.array_sort(F.collect_list(F.struct("j", "more"))), lambda x: x["more"]).alias("more")
    cells = stored(each.groupBy("rank", "shard").agg(*same, more), "mix")

    # A cell is small by construction, so one exchange by cell serves both the running sum and the join.
    line = Window.partitionBy("rank", "shard").orderBy("turn", "id", "size", "last").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt(rows).withColumn("end", F.sum("size").over(line)).withColumn("start", F.col("end") - F.col("size")).join(cells, ["rank", "shard"])

    def join_run(runs: Column, j: Column) -> Column:
        begin = F.greatest(F.col("start"), edge(j)) - F.col("start")
        end = F.least(F.col("end"), edge(j) + F.get("more", j.cast("int"))) - F.col("start")
        last = F.element_at(runs, -1)
        touches = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["end"] == begin)
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["begin"].alias("begin"), end.alias("end"))))
        return F.when(end <= begin, runs).when(touches, longer).otherwise(F.concat(runs, F.array(F.struct(begin.alias("begin"), end.alias("end")))))

    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    runs = F.when(F.col("size") > 0, F.aggregate(F.sequence(block_of(F.col("start")), block_of(F.col("end") - 1)), none, join_run)).otherwise(none)
    placed = placed.withColumn("runs", runs)
    taken = F.col("times") * F.col("size") + F.aggregate("runs", F.lit(0).cast("long"), lambda n, run: n + run["end"] - run["begin"])
    return placed.select("row", "size", "source_size", "target", taken.alias("taken"), "times", "runs")


def mix_sources(docs: DataFrame, keep: list[str] | None = None, **how) -> DataFrame:
    """Every row of docs (doc_id, text, source, ...) with the columns NEW; keep: those of docs' columns that pass through (all)."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in NEW]
    return mix_plan(docs, kept, **how).select(*[F.col("row").getField(c).alias(c) for c in kept], *NEW)


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def edge(j: Column) -> Column:
    """The word of a shard that its block j begins at."""
    return div(j * F.col("cell_size"), F.col("blocks"))


def block_of(word: Column) -> Column:
    return div((word + 1) * F.col("blocks") - 1, F.col("cell_size"))


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents with docs' columns: a row for each time a document is taken whole, and for each run of words.

    A run is a contiguous part of the text from the beginning of a word to the beginning of the next one that isn't taken;
    one that holds all words is the text as it is. n_chars, where present, is the new text's length.
    """
    rows = mix_plan(docs, docs.columns, **how).where("taken > 0")
    text = F.col("row").getField("text")
    whole = lambda run: (run["begin"] == 0) & (run["end"] == F.col("size"))
    split = F.regexp_extract_all(text, F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1))
    rows = rows.withColumn("split", F.when(F.exists("runs", lambda run: ~whole(run)), split))
    every = F.concat(F.array_repeat(F.struct(F.lit(0).cast("long").alias("begin"), F.col("size").alias("end")), F.col("times").cast("int")), F.col("runs"))
    rows = rows.select("row", "split", "size", F.explode(every).alias("run"))
    run = F.col("run")
    piece = F.array_join(F.slice("split", run["begin"].cast("int") + 1, (run["end"] - run["begin"]).cast("int")), "")
    # A generator, so that the text is put together once and not again for its length.
    rows = rows.select("row", F.explode(F.array(F.when(whole(run), text).otherwise(piece))).alias("piece"))
    new = {"text": F.col("piece")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("piece").cast(dict(docs.dtypes)["n_chars"])
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
