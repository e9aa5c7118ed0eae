"""Nested views over the search tables: runs, generations, evals, mixtures, experts."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import frames as W


def nested(parent: DataFrame, child: DataFrame, keys: list[str], order: str, fields: list[str], out: str) -> DataFrame:
    """parent with its children as an array of structs, by order. One join a level; parents without children are left out."""
    own = child.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias(out))
    return parent.join(own, keys)


def in_blocks(child: DataFrame, keys: list[str], order: str, fields: list[str], out: str, size: int = 1024) -> DataFrame:
    """(keys, part, out): a parent's children by (order, fields), `size` at a time; a whole number of order tells their bucket.

    Children are numbered inside buckets of order, whose sizes are summed up beside, so no task or row holds a large parent.
    """
    item = F.struct(F.col(order).alias(order), *[f for f in fields if f != order])
    line = child.select(*keys, F.to_json(F.struct(*keys)).alias("symbol"), F.expr(f"{order} div {4 * size}").alias("_range"), item.alias("ts"))
    placed = W.with_pos(line, F.col("_range")).withColumn("part", F.expr(f"pos div {size}"))
    return placed.groupBy(*keys, "part").agg(F.sort_array(F.collect_list("ts")).alias(out))


def experts_of_mixture(*kinds: DataFrame) -> DataFrame:
    """(mixture_id, ord, kind, id, ...) of the expert tables of all kinds; columns that only some have are null in others."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)


def entity_tree(runs: DataFrame, generations: DataFrame, gen_evals: DataFrame, mixtures: DataFrame, mixture_evals: DataFrame, experts: DataFrame, size: int = 1024) -> DataFrame:
    """(run_id, generation, fitness, part, mixtures): the tree of runs, level by level, all in order, `size` mixtures a row.

    runs (run_id), generations (generation_id, run_id, generation), gen_evals (generation_id, fitness), mixtures (mixture_id,
    generation_id), mixture_evals (mixture_id, fitness), experts (mixture_id, ord, kind, id). A mixture is (mixture_id, fitness,
    experts), its experts (ord, kind, id); one has a few. A generation and a mixture have one evaluation each: a run with a
    generation or a mixture that has none, or several, can't be assembled and goes whole. A mixture without experts has none.
    """
    one = lambda d, key: d.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("fitness").alias("fitness"))
    gens = generations.join(one(gen_evals, "generation_id"), "generation_id", "left")
    mixed = mixtures.join(one(mixture_evals, "mixture_id"), "mixture_id", "left")
    bad = lambda d: d.where("_n is null or _n <> 1")
    broken = bad(gens).select("run_id").unionByName(bad(mixed).join(generations, "generation_id").select("run_id")).distinct()
    own = experts.groupBy("mixture_id").agg(F.sort_array(F.collect_list(F.struct("ord", "kind", "id"))).alias("experts"))
    none = F.array().cast("array<struct<ord:bigint,kind:string,id:bigint>>")
    mixed = mixed.join(own, "mixture_id", "left").withColumn("experts", F.coalesce(F.col("experts").cast("array<struct<ord:bigint,kind:string,id:bigint>>"), none))
    blocks = in_blocks(mixed, ["generation_id"], "mixture_id", ["fitness", "experts"], "mixtures", size)
    whole = gens.join(runs.select("run_id"), "run_id", "left_semi").join(broken, "run_id", "left_anti")
    return whole.join(blocks, "generation_id").select("run_id", "generation", "fitness", "part", "mixtures")


def view_runs(runs: DataFrame, generations: DataFrame, evals: DataFrame) -> DataFrame:
    """Runs with their generations in order, each with its best fitness; runs that have none are left out."""
    best = evals.groupBy("run_id", "generation").agg(F.max("fitness").alias("fitness"))
    rows = generations.join(best, ["run_id", "generation"])
    return nested(runs, rows, ["run_id"], "generation", ["fitness"], "generations")


def fitness_series(evals: DataFrame) -> DataFrame:
    return evals.groupBy("run_id", "generation").agg(F.max("fitness").alias("fitness"))


def mixture_tree(mixtures: DataFrame, *kinds: DataFrame) -> DataFrame:
    """(mixture_id, experts): each mixture with the experts of all kinds (mixture_id, ord, kind, ...) in order, a kind's own fields null in others."""
    experts = experts_of_mixture(*kinds)
    return nested(mixtures, experts, ["mixture_id"], "ord", [c for c in experts.columns if c not in ("mixture_id", "ord")], "experts")


def run_description(runs: DataFrame) -> DataFrame:
    line = F.format_string("run %d on %s: %d bars from %s", "run_id", "symbol", "n", F.date_format("first_ts", "yyyy-MM-dd"))
    return runs.select("run_id", line.alias("description"))


def export_json(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("json"))
