"""Near-duplicate vectors by E8 lattice hashing, every link verified by cosine in double precision.

A table projects unit vectors with random directions onto blocks of eight coordinates, scales them, and decodes each
block to the nearest point of the lattice E8; a vector is filed under its own cell and under the cells that differ in
one block by one of the nearest neighbouring points. Vectors filed under one cell are compared. How many tables there
are follows from the share of pairs at the threshold that meet in one table, measured on random pairs of that
dimension, so that at most `miss` of such pairs meet nowhere; a threshold so low that MOST_TABLES don't suffice is refused.
How many blocks of eight a table has is a parameter, for more of them make cells smaller and tables more. Cells with over
BLOCK vectors are dealt to tasks as blocks of pairs. A vector carries the cells it shares with others that come before the
one it is compared in, so that each pair counts in the first of its common cells only: a task sends numbers of links and
the smallest id a vector reaches in its block, a row for each of its vectors, and no list of pairs is ever made.
Equal vectors are one class and never expanded into pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't link; vec_id is the key (rows that share one are one vertex, with the links of all its vectors; a
row's n_links are its own vector's), a null vec_id links with nothing, has a null component and is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import components, one_vertex, runs, stored

SCALE, PROBES, BLOCK, MOST_TABLES, CELLS, SMALL = 4.0, 3, 512, 512, 4096, 16


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [(i, j, a, b) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for n, (i, j, a, b) in enumerate(pairs):
        whole[n, i], whole[n, j] = a, b
    half = np.array([s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])
    return np.concatenate([whole, half])


ROOTS = roots()


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8: the better of the nearest even-sum integer points to x and, shifted by a half, to x - 1/2."""

    def even(y: np.ndarray) -> np.ndarray:
        z = np.rint(y)
        off = y - z
        odd = np.flatnonzero(z.sum(axis=1) % 2)
        worst = np.abs(off[odd]).argmax(axis=1)
        z[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return z

    a, b = even(x), even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cells(unit: np.ndarray, table: int, blocks: int) -> np.ndarray:
    """Keys of the cells that each unit vector is filed under in a table, its own first."""
    dim = unit.shape[1]
    rng = np.random.default_rng([dim, table, blocks])
    turn = rng.normal(size=(dim, 8 * blocks)) * SCALE / 8
    weigh = rng.integers(0, 2**64, (blocks, 8), np.uint64) | np.uint64(1)
    own, moved = np.uint64(rng.integers(0, 2**64, dtype=np.uint64)), []
    key = lambda p, b: ((2 * p).astype(np.int64).astype(np.uint64) * weigh[b]).sum(axis=-1, dtype=np.uint64)
    x = unit @ turn
    for b in range(blocks):
        part = x[:, 8 * b : 8 * b + 8]
        point = nearest(part)
        near = np.argpartition(-((part - point) @ ROOTS.T), PROBES, axis=1)[:, :PROBES]
        home = key(point, b)
        own = own + home
        moved.append(key(point[:, None, :] + ROOTS[near], b) - home[:, None])
    return np.concatenate([own[:, None], *[own[:, None] + m for m in moved]], axis=1).view(np.int64)


@lru_cache(maxsize=64)
def tables(dim: int, blocks: int, threshold: float, miss: float) -> int:
    """Tables that leave at most `miss` of the pairs at the threshold without a common cell."""
    rng = np.random.default_rng(dim)
    x, y = rng.normal(size=(2, 4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim == 1:
        return 1
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = threshold * x + np.sqrt(1 - threshold**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    a, b = cells(x, 0, blocks), cells(y, 0, blocks)
    meet = (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean()
    n = max(1, int(np.ceil(np.log(miss) / np.log(1 - min(max(meet, 1e-9), 0.999)))))
    if n > MOST_TABLES:
        raise ValueError(f"{n} tables would be needed at this threshold, miss and number of blocks; {MOST_TABLES} are the most")
    return n


def usable(vector: str) -> F.Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def unit_rows(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def promising(unit: np.ndarray, edges: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the runs of rows between edges are longer than SMALL, or hold two rows about as near as the threshold."""
    size = np.diff(edges)
    good = size > SMALL
    run = np.repeat(np.arange(len(size)), size)
    short = ~good[run]
    for d in range(1, min(SMALL, size.max(initial=0))):
        a = np.flatnonzero(short[:-d] & (run[:-d] == run[d:]))
        good[run[a[np.einsum("ij,ij->i", unit[a], unit[a + d]) >= threshold - 1e-9]]] = True
    return good


def met_before(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which of the left and right rows have a common cell among those that each lists."""
    met = np.zeros((len(left), len(right)), bool)
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for at in range(0, len(common), CELLS):
        some = common[at : at + CELLS]
        member = []
        for rows in (left, right):
            flat = np.concatenate(rows)
            place = np.minimum(np.searchsorted(some, flat), len(some) - 1)
            inside = some[place] == flat
            table = np.zeros((len(rows), len(some)), np.float32)
            table[np.repeat(np.arange(len(rows)), [len(v) for v in rows])[inside], place[inside]] = 1
            member.append(table)
        met |= member[0] @ member[1].T > 0
    return met


def least_linked(hit: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that left and right rows reach by the links of hit; same: left and right are the same rows."""
    most = np.iinfo(np.int64).max
    while True:
        x = np.minimum(left, np.where(hit, right[None, :], most).min(axis=1, initial=most))
        y = x if same else np.minimum(right, np.where(hit, x[:, None], most).min(axis=0, initial=most))
        if (x == left).all() and (y == right).all():
            return x, y
        left, right = x, y


def cosine_links(vectors: DataFrame, threshold: float = 0.9, miss: float = 0.005, blocks: int = 2) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, ...)."""
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding")
    named = vectors.where(usable("embedding") & F.col("vec_id").isNotNull())
    mark = F.xxhash64("embedding").alias("mark")  # tells the vectors of one id apart
    classes = stored(named.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("mark", mark), "lattice-classes")

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, some in batch.groupby(batch["embedding"].map(len)):
                unit = unit_rows(some["embedding"].tolist())
                for t in range(tables(int(dim), blocks, threshold, miss)):
                    found = cells(unit, t, blocks)
                    yield pd.DataFrame({"cell": found.ravel(), **{c: np.repeat(some[c].to_numpy(), found.shape[1]) for c in ("id", "mark")}})

    filed = stored(classes.select("id", "mark", "embedding").mapInPandas(file, "cell long, id long, mark long"), "lattice-cells")
    parts = filed.groupBy("cell").agg(F.count(F.lit(1)).alias("in_cell")).where("in_cell > 1")
    # Each class with the cells it shares, the fullest first: an order all classes agree on. A pair belongs to the first cell common to both.
    listed = F.array_sort(F.collect_list(F.struct((-F.col("in_cell")).alias("less"), "cell"))).alias("cells")
    listed = filed.join(parts, "cell").groupBy("id", "mark").agg(listed).join(classes, ["id", "mark"])
    wide = listed.select("id", "mark", "n", "embedding", "cells", F.posexplode("cells").alias("at", "own"))
    wide = wide.select("id", "mark", "n", "embedding", F.col("own.cell").alias("cell"), F.ceil(-F.col("own.less") / BLOCK).cast("int").alias("k"), F.slice("cells.cell", 1, F.col("at")).alias("before"))
    wide = wide.withColumn("c", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    wide = wide.withColumn("i", F.least("c", "d")).withColumn("j", F.greatest("c", "d"))
    wide = wide.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in runs(batches, ["cell", "i", "j"]):
            keys, before = batch[["cell", "i", "j"]].to_numpy(), batch["before"].to_numpy()
            ids, n, c = batch["id"].to_numpy(), batch["n"].to_numpy(), batch["c"].to_numpy()
            lengths = batch["embedding"].map(len).to_numpy()
            out = []
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                unit, k = unit_rows(batch["embedding"].iloc[own].tolist()), keys[own]
                edges = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1), True])
                near = np.flatnonzero(promising(unit, edges, threshold))
                for at, end in zip(edges[near], edges[near + 1], strict=True):
                    some = np.arange(at, end)
                    same = bool(k[at, 1] == k[at, 2])
                    left = some if same else some[c[own[some]] == k[at, 1]]
                    right = some if same else some[c[own[some]] == k[at, 2]]
                    hit = (unit[left] @ unit[right].T >= threshold) & (ids[own[left]][:, None] != ids[own[right]][None, :])
                    if same:
                        hit |= hit.T
                    x, y = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
                    if not len(x):
                        continue
                    left, right, hit = own[left[x]], own[right[y]], hit[np.ix_(x, y)]
                    hit &= ~met_before(list(before[left]), list(before[right]))
                    if not hit.any():
                        continue
                    roots = least_linked(hit, ids[left], ids[right], same)
                    for rows, root, linked in zip((left, right)[: 2 - same], roots, (hit @ n[right], n[left] @ hit), strict=False):
                        some = linked > 0
                        out.append(np.stack([rows[some], root[some], linked[some]], axis=1))
            if out:
                rows, root, linked = np.concatenate(out).T
                found = pd.DataFrame({"id": ids[rows], "mark": batch["mark"].to_numpy()[rows], "root": root, "linked": linked})
                yield found.groupby(["id", "mark", "root"], as_index=False)["linked"].sum()

    ends = wide.select("cell", "id", "mark", "c", "i", "j", "n", "embedding", "before").mapInPandas(compare, "id long, mark long, root long, linked long")
    ends = stored(ends, "lattice-links")
    degrees = ends.groupBy("id", "mark").agg(F.sum("linked").alias("linked"))
    links = ends.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b")
    good = F.col("vec_id").isNotNull() & usable("embedding")
    keyed = vectors.select(F.col("vec_id").alias("id"), F.when(good, F.col("embedding")).alias("embedding"))
    every, several = one_vertex(links, keyed, classes.select("embedding", F.col("id").alias("first")), "embedding", "lattice")
    found = components(every, "lattice-components")
    copies = classes.where("n > 1").select("embedding", F.col("id").alias("first"), "n")
    out = vectors.withColumn("good", good).join(copies, "embedding", "left").withColumn("id", F.when(F.col("good"), F.coalesce("first", "vec_id")))
    out = out.withColumn("mark", mark).join(degrees, ["id", "mark"], "left").drop("id").join(several.withColumnRenamed("id", "of"), F.col("vec_id") == F.col("of"), "left")
    out = out.withColumn("id", F.coalesce("vertex", F.when(F.col("good"), F.coalesce("first", "vec_id")))).join(found, "id", "left")
    n_links = F.when(F.col("good"), F.coalesce("linked", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).otherwise(0).cast("long")
    out = out.select("vec_id", n_links.alias("n_links"), F.coalesce("component_id", "id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
