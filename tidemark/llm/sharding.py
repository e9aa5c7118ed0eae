"""Shards of near equal bytes by minimax contiguous partition of ordered atomic groups (DataFrame functions only).

Groups of equal texts stay together. Groups lie in hash order; the least shard capacity for which a greedy walk needs no
more than the given shards is found by binary search, and the walk's cuts at that capacity are the shards. The search
runs on bounded summaries: groups' end offsets are summarised in bins, the walk is done once with the latest end that
may exist (a lower bound of the capacity) and once with ends known to exist (an upper bound), and only bins that lie
between the cuts of the two walks are split, until both bounds agree. A bin is never made coarser, and each split takes at
least two bits off its width, so the search ends; a round splits BINS / 4 bins (or as many as there are shards, if more)
into 2 * BINS (4 * shards) at most, and the driver holds the bins it split.

Defined results: null text has no bytes (size 1, crc 0), and all null texts are one group; empty text is another group;
null doc_ids and repeated rows are rows like any other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

#: Buckets of the hash order, parts a large group is dealt to, bins of an offset summary.
BUCKETS, SALTS, BINS = 4096, 64, 8192


class Bin(NamedTuple):
    """Group ends that agree in all bits of (end - 1) from `level` on: the first, the last, and how many there are."""

    first: int
    last: int
    n: int
    level: int


class Offsets:
    """Groups' end offsets as far as known, in sorted bins."""

    def __init__(self, bins: list[Bin]):
        self.bins = sorted(bins)
        self.firsts = [b.first for b in self.bins]

    def last_end(self, x: int, sure: bool) -> int:
        """The last group end at or before x: one that is known to exist, or (not sure) the latest that may exist."""
        i = bisect_right(self.firsts, x) - 1
        if i < 0:
            return 0
        own = self.bins[i]
        if x >= own.last:
            return own.last
        return own.first if sure or own.n <= 2 else x

    def walk(self, capacity: int, shards: int, sure: bool) -> list[int]:
        cuts = [0]
        for _ in range(shards):
            cuts.append(self.last_end(cuts[-1] + capacity, sure))
        return cuts[1:]

    def least(self, total: int, shards: int, sure: bool) -> int:
        low, high = -(-total // shards), total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.walk(mid, shards, sure)[-1] >= total else (mid + 1, high)
        return low

    def between(self, early: list[int], late: list[int], most: int) -> list[Bin]:
        """The first `most` bins with ends not known yet that lie between two walks' cuts, those of the first cuts first."""
        found: dict[Bin, None] = {}
        for x, y in zip(early, late, strict=True):
            i = max(0, bisect_right(self.firsts, min(x, y)) - 1)
            for own in self.bins[i : bisect_right(self.firsts, max(x, y))]:
                if own.n > 2 and own.last >= min(x, y):
                    found[own] = None
                    if len(found) == most:
                        return list(found)
        return list(found)


def finer(ends: DataFrame, end: str, bins: list[Bin], by: int) -> list[Bin]:
    """The ends of the given bins in bins `by` levels below: len(bins) << by of them at most."""
    names = F.split(F.lit(",".join(f"{b.level}:{(b.first - 1) >> b.level}" for b in bins)), ",")
    wanted = ends.sparkSession.range(1).select(F.explode(names).alias("_name"))  # BINS / 4 rows or the number of shards at most
    wanted = wanted.select(F.split("_name", ":")[0].cast("int").alias("_level"), F.split("_name", ":")[1].cast("long").alias("_prefix"))
    at = (F.col(end).cast("long") - 1).alias("_at")
    rows = ends.select(at, F.explode(F.array(*[F.lit(x) for x in sorted({b.level for b in bins})])).alias("_level"))
    rows = rows.withColumn("_prefix", F.expr("shiftright(_at, _level)")).join(F.broadcast(wanted), ["_level", "_prefix"])
    rows = rows.withColumn("_level", F.greatest(F.col("_level") - by, F.lit(0)))
    found = rows.groupBy("_level", F.expr("shiftright(_at, _level)").alias("_bin")).agg(F.min("_at"), F.max("_at"), F.countDistinct("_at")).collect()
    return [Bin(r[2] + 1, r[3] + 1, r[4], r[0]) for r in found]


def searched(total: int, shards: int, refine: Callable[[list[Bin], int], list[Bin]]) -> list[int]:
    """The group ends at which to cut 0..total into shards contiguous parts of least largest size.

    refine(bins, by) gives bins `by` levels finer for some bins. A bin is only ever replaced by finer ones, those of the
    first cuts first. Where no bin with unknown ends lies between the two walks, the walk at the lower bound met known
    ends only, so both bounds are one.
    """
    bins: list[Bin] = []
    coarse = [Bin(1, total, total, total.bit_length())]
    while True:
        new = refine(coarse, max(2, (BINS // len(coarse)).bit_length() - 1))
        bins = [b for b in bins if b not in set(coarse)] + new
        known = Offsets(bins)
        high, low = known.least(total, shards, True), known.least(total, shards, False)
        coarse = known.between(known.walk(low, shards, False), known.walk(high, shards, True), max(BINS // 4, shards))
        if high == low or not coarse:
            return known.walk(high, shards, True)


def minimax_cuts(ends: DataFrame, end: str, total: int, shards: int) -> list[int]:
    """The group ends of a table at which to cut 0..total into shards contiguous parts of least largest size."""
    return searched(total, shards, lambda bins, by: finer(ends, end, bins, by))


def crc(text: Column) -> Column:
    return F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")


def shard_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs (doc_id, text, ...)."""
    text = F.col("text")
    key = F.coalesce(F.substring(F.sha2(text.cast("binary"), 256), 1, 32), F.lit("none"))
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    rows = docs.select("doc_id", size.alias("size"), crc(text).alias("text_crc32"), key.alias("key"))
    rows = stored(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(SALTS))), "shards")
    cells = rows.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    line = Window.partitionBy("bucket").orderBy("key")
    cells = cells.withColumn("row_end", F.sum("n").over(line.orderBy("key", "salt").rowsBetween(Window.unboundedPreceding, 0)))
    cells = stored(cells.withColumn("byte_end", F.sum("bytes").over(line.rangeBetween(Window.unboundedPreceding, 0))), "shards")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = cells.groupBy("bucket").agg(F.sum("n").alias("_n"), F.sum("bytes").alias("_b"))  # at most BUCKETS rows
    buckets = buckets.select("bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("bytes_before"))
    cells = cells.join(F.broadcast(buckets), "bucket")
    cells = stored(cells.select("key", "salt", "n", (F.col("rows_before") + F.col("row_end") - F.col("n")).alias("row_start"), (F.col("bytes_before") + F.col("byte_end")).alias("end")), "shards")
    total = cells.agg(F.max("end")).first()[0] or 0
    cuts = minimax_cuts(cells, "end", total, shards)[:-1] if total else [0] * (shards - 1)
    counts = cells.agg(*[F.coalesce(F.sum(F.when(F.col("end") <= c, F.col("n"))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(cuts)], F.lit(0).alias("_")).first()
    shard = sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    starts = F.array(F.lit(0).cast("long"), *[F.lit(counts[i]).cast("long") for i in range(shards - 1)])
    placed = rows.join(cells.select("key", "salt", "row_start", shard.alias("shard")), ["key", "salt"])
    at = Window.partitionBy("key", "salt").orderBy("doc_id")
    slot = F.col("row_start") + F.row_number().over(at) - 1 - F.get(starts, F.col("shard"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
