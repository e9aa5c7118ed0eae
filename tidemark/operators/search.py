"""Search over candidate tables: grids, random genes, selection, crossover, mutation, generations.

All draws hash (seed, keys), so a retried task draws what the first try drew.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators.halo import ROWS, halo


def _line(low: float, step: float) -> Callable[[Column], Column]:
    return lambda k: k * step + low


def param_grid(spark: SparkSession, ranges: dict[str, tuple[float, float, float]]) -> DataFrame:
    """All combinations of low, low + step, ... high; values come from whole steps. The grid is as large as its ranges say."""
    grid = spark.range(1).select()
    for name, (low, high, step) in ranges.items():
        n = int((high - low) / step + 1e-9)
        grid = grid.withColumn(name, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), _line(low, step))))
    return grid


def draw(seed: int, *keys: str) -> Column:
    return S.uniform(seed, 0.0, 1.0, *keys)


def random_candidates(spark: SparkSession, n: int, specs: DataFrame, seed: int) -> DataFrame:
    """(candidate, name, value): n candidates with a value for each gene (name, min, max, granularity) of specs.

    Specs are a search's few genes; they multiply the candidates on purpose.
    """
    rows = spark.range(n).withColumnRenamed("id", "candidate").join(specs)
    u = draw(seed, "candidate", "name")
    raw = F.col("min") + u * (F.col("max") - F.col("min"))
    step = F.when(F.col("granularity") > 0, F.rint((raw - F.col("min")) / F.col("granularity")) * F.col("granularity") + F.col("min")).otherwise(raw)
    return rows.select("candidate", "name", F.least("max", step).alias("value"))


def gene_spec(genes: DataFrame, specs: DataFrame) -> DataFrame:
    return genes.join(specs, "name")


def top_k(df: DataFrame, k: int, key: str, tie: str, *group: str) -> DataFrame:
    """k rows of highest key, of all or of each group; ties to the smaller tie."""
    if not group:
        return df.orderBy(F.col(key).desc(), tie).limit(k)
    best = Window.partitionBy(*group).orderBy(F.col(key).desc(), tie)
    return df.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k).drop("_k")


def best_mixture(evals: DataFrame) -> DataFrame:
    """(run_id, mixture_id, fitness): the first of highest fitness in each run."""
    at = F.struct("fitness", -F.col("mixture_id"))
    return evals.groupBy("run_id").agg(F.max_by("mixture_id", at).alias("mixture_id"), F.max("fitness").alias("fitness"))


def weighted_intervals(items: DataFrame, picks: DataFrame, buckets: int = 256) -> DataFrame:
    """(pick, id, low, high): for each pick's u in 0..1 the item (id, quality) whose interval low..high of the cumulative quality holds it.

    Intervals are kept in order of id; an item with no quality is never picked. Ids, which are numbers, are cut into buckets
    at their quantiles; only a bucket's total takes part in the running sum over all, and picks find their bucket first.
    """
    able = items.where("quality > 0").select("id", F.col("quality").cast("double").alias("quality"))
    cuts = able.agg(F.percentile_approx("id", [k / buckets for k in range(1, buckets)]).alias("_cuts"))
    dealt = able.join(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("id")))).drop("_cuts")
    line = Window.orderBy("_b")  # over the few buckets
    totals = dealt.groupBy("_b").agg(F.sum("quality").alias("_own")).withColumn("_end", F.sum("_own").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    totals = totals.withColumn("_start", F.coalesce(F.lag("_end").over(line), F.lit(0.0))).withColumn("_all", F.max("_end").over(Window.partitionBy())).drop("_own")
    own = Window.partitionBy("_b").orderBy("id")
    bounds = dealt.join(F.broadcast(totals), "_b").withColumn("_to", F.col("_start") + F.sum("quality").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    bounds = bounds.withColumn("_to", F.when(F.lead("id").over(own).isNull(), F.col("_end")).otherwise(F.col("_to")))
    bounds = bounds.withColumn("_from", F.coalesce(F.lag("_to").over(own), "_start")).select("_b", "id", (F.col("_from") / F.col("_all")).alias("_from"), (F.col("_to") / F.col("_all")).alias("_to"))
    placed = picks.join(F.broadcast(totals), (F.col("u") >= F.col("_start") / F.col("_all")) & (F.col("u") < F.col("_end") / F.col("_all"))).select("pick", "u", "_b")
    found = placed.join(bounds, "_b").where((F.col("u") >= F.col("_from")) & (F.col("u") < F.col("_to")))
    return found.select("pick", "id", F.col("_from").alias("low"), F.col("_to").alias("high"))


def weighted_pick(items: DataFrame, picks: DataFrame, buckets: int = 256) -> DataFrame:
    """(pick, id): the item that each pick (pick, u) falls on, u in 0..1."""
    return weighted_intervals(items, picks, buckets).select("pick", "id")


def weighted_pick_two(items: DataFrame, pairs: DataFrame, seed: int) -> DataFrame:
    """(pair, first, second): two different items by quality, drawn one after the other; second is null where there is but one.

    The second draw falls on what the first leaves of the interval 0..1: past the first item's part it is moved up by that.
    """
    drawn = pairs.select("pair").withColumn("u", draw(seed, "pair")).withColumn("v", draw(seed + 1, "pair"))
    first = weighted_intervals(items, drawn.select(F.col("pair").alias("pick"), "u"))
    first = written(first.select(F.col("pick").alias("pair"), F.col("id").alias("first"), "low", "high"))
    rest = F.col("v") * (1 - (F.col("high") - F.col("low")))
    again = drawn.join(first, "pair").select(F.col("pair").alias("pick"), F.when(rest >= F.col("low"), rest + (F.col("high") - F.col("low"))).otherwise(rest).alias("u"))
    second = weighted_intervals(items, again).select(F.col("pick").alias("pair"), F.col("id").alias("second"))
    both = first.select("pair", "first").join(second, "pair", "left")
    return both.withColumn("second", F.when(F.col("second") != F.col("first"), F.col("second")))


def crossover(a: DataFrame, b: DataFrame, coin: Column) -> DataFrame:
    """Children of parent pairs, gene by gene: (pair, ord, name, x, y), swapped where coin (of pair, ord, name) is true."""
    both = a.select("pair", "ord", "name", F.col("value").alias("x")).join(b.select("pair", "ord", "name", F.col("value").alias("y")), ["pair", "ord", "name"])
    swap = both.withColumn("_swap", coin)
    return swap.select("pair", "ord", "name", F.when(F.col("_swap"), F.col("y")).otherwise(F.col("x")).alias("x"), F.when(F.col("_swap"), F.col("x")).otherwise(F.col("y")).alias("y"))


def mutate(genes: DataFrame, specs: DataFrame, rate: float, seed: int) -> DataFrame:
    """Genes (candidate, name, value), each redrawn from its spec at a rate."""
    rows = genes.join(specs, "name")
    raw = F.col("min") + draw(seed + 1, "candidate", "name") * (F.col("max") - F.col("min"))
    new = F.when(F.col("granularity") > 0, F.least("max", F.rint((raw - F.col("min")) / F.col("granularity")) * F.col("granularity") + F.col("min"))).otherwise(raw)
    return rows.select("candidate", "name", F.when(draw(seed, "candidate", "name") < rate, new).otherwise(F.col("value")).alias("value"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder all executors share, below spark.checkpoint.dir; only where that is unset and executors run here, one of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return f"{context.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df stored in the session's checkpoint folder and read back, which ends its lineage."""
    path = scratch(df.sparkSession, "search")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def evolve(spark: SparkSession, specs: DataFrame, evaluate: Callable[[DataFrame], DataFrame], n: int, keep: int, generations: int, rate: float, seed: int) -> DataFrame:
    """(generation, candidate, fitness) of a genetic search: draw, evaluate, select, cross, mutate.

    evaluate: genes (candidate, name, value) -> (candidate, fitness). Each generation is stored, so lineage doesn't grow.
    Parents are drawn by fitness: those of none or less are left out, unless no parent has any; then all are alike. A parent
    that is alone pairs with itself, so that every generation has n candidates.
    """
    genes, history = written(random_candidates(spark, n, specs, seed)), None
    for g in range(generations):
        scored = written(evaluate(genes))
        rows = scored.select(F.lit(g).alias("generation"), "candidate", "fitness")
        history = rows if history is None else history.unionByName(rows)
        if g + 1 == generations:
            break
        parents = written(top_k(scored, keep, "fitness", "candidate").select(F.col("candidate").alias("id"), F.col("fitness").alias("quality")))
        if parents.where("quality > 0").isEmpty():
            parents = parents.withColumn("quality", F.lit(1.0))
        couples = weighted_pick_two(parents, spark.range((n + 1) // 2).withColumnRenamed("id", "pair"), seed + 10 * g + 1)
        couples = written(couples.withColumn("second", F.coalesce("second", "first")))
        side = lambda c: couples.join(genes, couples[c] == genes["candidate"]).select("pair", F.lit(0).alias("ord"), "name", "value")
        children = crossover(side("first"), side("second"), draw(seed + 10 * g + 2, "pair", "ord", "name") < 0.5)
        both = children.select((2 * F.col("pair")).alias("candidate"), "name", F.col("x").alias("value")).unionByName(children.select((2 * F.col("pair") + 1).alias("candidate"), "name", F.col("y").alias("value")))
        genes = written(mutate(both.where(F.col("candidate") < n), specs, rate, seed + 10 * g + 3))
    return history


def grid_search(bars: DataFrame, grid: DataFrame, kernel: Callable[[DataFrame], DataFrame], prepare: Callable[[DataFrame], DataFrame] | None = None, reach: int = 0, ahead: int = 0, most: int = 10_000) -> DataFrame:
    """(candidate columns, fitness) of each grid point: kernel(grid x bars) with the signal as column expressions.

    prepare looks back `reach` rows and ahead `ahead` (bars with pos) and runs once, in buckets, before the grid multiplies
    the bars; kernel then works row by row and aggregates. A grid of up to `most` points is sent to all tasks.
    """
    rows = bars if prepare is None else halo(bars, reach, ROWS, prepare, ahead)
    return kernel(rows.join(F.broadcast(grid) if grid.count() <= most else grid))
