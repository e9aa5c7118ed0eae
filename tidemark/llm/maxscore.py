"""Exact top-k by integer inner product with MaxScore over sharded postings.

Vectors are quantised to whole numbers. A term is a dimension with a sign; its postings in a shard are the rows whose
component has that sign, in order of vec_id, with the components. A query's bound for a dimension is the most that it can
add in the shard, and a set of dimensions adds at most the sum of their bounds, or the product of both sides' norms where
that is less. With a threshold that k rows are known to reach, the dimensions whose set can't reach it are non-essential:
the essential postings are traversed, adding up scores, and the rows that could still reach the threshold are probed in
the other dimensions, largest bound first, as long as they stay competitive. What is left is scored in whole numbers.

1. Rows are dealt to shards by their heaviest term, so that a shard's rows resemble each other, in shards of even size.
2. Every query is searched in the shard of its own row. Its k-th best score there is its threshold everywhere else.
3. Summaries of the shards (largest and least component by dimension, longest row) are compared with blocks of queries;
   a (query, shard) pair whose bounds stay below the threshold is never shuffled, nor is a shard that no query is left for.
4. The pairs that are left are searched, a block of queries and a shard a task, and merged by score, ties to the smaller
   vec_id.

Defined results: vectors that are null, hold null or non-finite components (or such whose 256-fold is beyond a double), or
have a null vec_id take no part; a shorter vector counts as followed by zeros, an empty one scores 0; a query's own row is
every row with its vec_id; rows that repeat a query are one query; scores beyond 64 bits are held at the limits; other
columns are ignored; an empty table gives an empty result; k is any whole number from 1 on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

#: Rows a shard aims at, queries of a block, shards whose summaries a task compares with a block of queries.
SHARD_ROWS, GROUP_QUERIES, SUMMARIES = 4096, 1024, 512
#: Rows scored in full where there is no threshold yet (at least, and 2 k at least); dimensions probed at a time.
FIRST, STEP = 128, 8
LIMIT = 2**63 - 1
#: Stands for a threshold that isn't known yet.
NONE = -LIMIT - 1
FOUND = "shard long, query_id long, query_key long, vec_id long, score long, high array<double>, low array<double>, norm double"


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, term) of the usable rows: v = floor(256 x), term = the dimension of its largest component, -1 - it if negative."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    down = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", fine), F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: down(x.cast("double") * 256)).alias("v"))
    rows = rows.where(F.forall("v", fine))
    size = F.transform("v", F.abs)
    at = (F.array_position(size, F.array_max(size)) - 1).cast("int")
    return rows.withColumn("term", F.coalesce(F.when(F.get("v", at) < 0, -1 - at).otherwise(at), F.lit(0)))


def matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def halved(x: np.ndarray) -> tuple[np.ndarray, int]:
    """x over 2^e, e so large that products and squares stay finite (0 for all but huge numbers), and e."""
    most = float(np.abs(x).max(initial=0))
    e = max(0, int(np.frexp(most)[1]) - 480)
    return np.ldexp(x, -e) if e else x, e


class Shard:
    """Rows in order of vec_id, with postings by dimension and sign."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.exact, self.ids = rows[order], ids[order]
        self.rows, self.e = halved(self.exact)
        self.high, self.low = self.rows.max(axis=0), self.rows.min(axis=0)
        self.norms = np.sqrt((self.rows**2).sum(axis=1))
        self.postings = []
        for x in self.rows.T:
            up, down = np.flatnonzero(x > 0), np.flatnonzero(x < 0)
            self.postings.append(((up, x[up]), (down, x[down])))

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Scores of some rows as whole numbers, held at the limits of a long."""
        part, out = self.exact[at], np.zeros(len(at), np.int64)
        with np.errstate(over="ignore"):
            sure = np.abs(part) @ np.abs(query) < 2**53  # each sum is a whole number that a double holds
        out[sure] = part[sure] @ query
        whole = [int(x) for x in query] if not sure.all() else []
        for i in np.flatnonzero(~sure):
            out[i] = max(-LIMIT - 1, min(LIMIT, sum(int(a) * b for a, b in zip(part[i], whole, strict=True))))
        return out

    def best(self, query: np.ndarray, own: int, k: int, threshold: int = NONE) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows (fewer if others stay below the threshold), by score, then by id."""
        others = self.ids != own
        if threshold == NONE:
            first = np.flatnonzero(others)[: max(FIRST, 2 * k)]
            known = self.scores(first, query)
            if len(first) == others.sum() or k > len(first):
                return self.sorted(first, known, k)
            threshold = int(-np.partition(-known, k - 1)[k - 1])
        q, e = halved(query)
        least = np.ldexp(float(threshold), -self.e - e)
        bounds = np.where(q > 0, q * np.maximum(self.high, 0), q * np.minimum(self.low, 0))
        dims = np.argsort(-bounds, kind="stable")
        dims = dims[q[dims] != 0]
        # Of the dimensions from the j-th on: the sum of their bounds, and the query's length in them.
        left = np.r_[np.cumsum(bounds[dims][::-1])[::-1], 0]
        length = np.r_[np.sqrt(np.cumsum(q[dims][::-1] ** 2)[::-1]), 0]
        # What sums in double precision may be off by, row by row.
        slack = (len(q) + 4) * 2.0**-52 * float(np.sqrt((q**2).sum())) * self.norms + 2.0**-52 * abs(least)
        below = np.minimum(left, length * self.norms.max()) < least - slack.max()
        m = int(np.argmax(below)) if below.any() else len(dims)
        total = np.zeros(len(self.ids))
        for d in dims[:m]:
            for at, x in self.postings[d]:
                total[at] += q[d] * x
        might = lambda sums, at, j: sums + np.minimum(left[j], length[j] * self.norms[at]) + slack[at] >= least
        at = np.flatnonzero(others & might(total, slice(None), m))
        total = total[at]
        while m < len(dims) and len(at):
            some = dims[m : m + STEP]
            total = total + self.rows[np.ix_(at, some)] @ q[some]
            m = min(m + STEP, len(dims))
            stay = might(total, at, m)
            at, total = at[stay], total[stay]
        return self.sorted(at, self.scores(at, query), k)

    def sorted(self, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[at], ~scores))[:k]  # ~ rather than -, which the least long hasn't
        return self.ids[at][order], scores[order]


def best_in_shard(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of one shard, without a threshold to begin with."""
    return Shard(rows, ids).best(query, own, k)


def search(queries: pd.DataFrame, rows: pd.DataFrame, k: int, summary: bool = False) -> pd.DataFrame:
    """The k best rows of a shard for each query (vec_id, query_key, v, threshold), and the shard's summary if asked for."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    none = pd.DataFrame({c: pd.Series(dtype=object) for c in names})
    if not len(rows):
        return none
    number, dim = int(rows["shard"].iloc[0]), max(1, int(rows["v"].map(len).max()), int(queries["v"].map(len).max() if len(queries) else 0))
    shard = Shard(matrix(rows["v"], dim), rows["vec_id"].to_numpy())
    out = []
    for own, key, q, threshold in zip(queries["vec_id"], queries["query_key"], matrix(queries["v"], dim), queries["threshold"], strict=True):
        found, scores = shard.best(q, own, k, threshold)
        out += [(number, own, key, i, s, None, None, None) for i, s in zip(found.tolist(), scores.tolist(), strict=True)]
    if summary:  # a row with high; its other columns hold nothing
        with np.errstate(over="ignore"):
            norm = np.sqrt((shard.exact**2).sum(axis=1)).max()
        out.append((number, 0, 0, 0, 0, shard.exact.max(axis=0), shard.exact.min(axis=0), float(norm)))
    return pd.DataFrame({c: pd.Series(x, dtype="int64" if i < 5 else object) for i, (c, x) in enumerate(zip(names, zip(*out, strict=True), strict=True))}) if out else none


def open_pairs(queries: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
    """Queries (part, vec_id, query_key, home, threshold, v) with each shard (shard, high, low, norm) whose rows might reach their threshold."""
    names = ["part", "shard", "vec_id", "query_key", "threshold", "v"]
    out = []
    if len(queries) and len(shards):
        dim = max(int(queries["v"].map(len).max()), int(shards["high"].map(len).max()))
        # Rows shorter than the longest may hold zeros beyond their summary: a bound is never below 0.
        q, high, low = matrix(queries["v"], dim), np.maximum(matrix(shards["high"], dim), 0), np.minimum(matrix(shards["low"], dim), 0)
        with np.errstate(over="ignore", invalid="ignore"):
            box = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
            round_ = np.sqrt((q**2).sum(axis=1))[:, None] * shards["norm"].to_numpy()[None, :]
            most = np.fmin(np.where(np.isnan(box), np.inf, box), np.where(np.isnan(round_), np.inf, round_)) * (1 + 1e-9)
        least = queries["threshold"].to_numpy(np.float64)
        least = np.where(least == float(NONE), -np.inf, least - 1e-9 * np.abs(least))
        meet = (most >= least[:, None]) & (queries["home"].to_numpy()[:, None] != shards["shard"].to_numpy()[None, :])
        i, j = np.nonzero(meet)
        out = queries.iloc[i].assign(shard=shards["shard"].to_numpy()[j])[names]
    return out if len(out) else pd.DataFrame({c: pd.Series(dtype=object) for c in names})


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each row of vectors (vec_id, embedding) with is_query."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = stored(quantised(vectors), "search-rows")
    # As many rows as there are terms reach the driver, two a dimension.
    terms = sorted((r["term"], r["n"]) for r in rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect())
    begins, n = {}, 0
    for term, own in terms:
        begins[term] = (n, own)
        n += own
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.create_map(*[x for t, (at, own) in begins.items() for x in (F.lit(t), F.struct(F.lit(at).cast("long").alias("at"), F.lit(own).cast("long").alias("own")))])
    own = place[F.col("term")]
    # A row's place among those of its term is drawn by hash, of its partition too, so that a repeated vec_id is spread.
    drawn = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), own["own"])
    held = stored(rows.withColumn("shard", F.floor((own["at"] + drawn) / SHARD_ROWS)).drop("term"), "search-shards")
    asked = held.where(is_query).groupBy("vec_id", "v").agg(F.min("shard").alias("home")).withColumn("query_key", F.xxhash64("v"))
    m = asked.count()
    groups = max(1, -(-m // GROUP_QUERIES))
    asked = stored(asked.withColumn("part", F.pmod(F.xxhash64("vec_id", "query_key"), F.lit(groups)).cast("int")), "search-queries")

    at_home = asked.select(F.col("home").alias("shard"), "vec_id", "query_key", "v", F.lit(NONE).alias("threshold"))
    pairs = at_home.groupBy("shard").cogroup(held.groupBy("shard"))
    first = stored(pairs.applyInPandas(lambda q, s: search(q, s, k, True), FOUND), "search-home")
    summaries = first.where("high is not null").select("shard", "high", "low", "norm")
    found = first.where("high is null").select("query_id", "query_key", "vec_id", "score")
    reached = found.groupBy("query_id", "query_key").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    reached = reached.where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "query_key", F.col("least").alias("threshold"))
    known = asked.join(reached, ["vec_id", "query_key"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(NONE)))

    chunks = -(-(-(-n // SHARD_ROWS)) // SUMMARIES)
    known = known.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    listed = summaries.withColumn("chunk", F.pmod("shard", F.lit(chunks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = known.groupBy("part", "chunk").cogroup(listed.groupBy("part", "chunk"))
    open_ = stored(met.applyInPandas(open_pairs, "part int, shard long, vec_id long, query_key long, threshold long, v array<double>"), "search-open")
    needed = held.join(open_.select(F.col("part").alias("part"), F.col("shard").alias("shard")).distinct(), "shard")
    rest = open_.groupBy("part", "shard").cogroup(needed.groupBy("part", "shard")).applyInPandas(lambda q, s: search(q, s, k), FOUND)
    every = found.unionByName(rest.select("query_id", "query_key", "vec_id", "score"))
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    every = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return every.select("query_id", "rank", "vec_id", "score")
