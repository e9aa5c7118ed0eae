"""Helpers the operators of this subpackage share: the shared folder, stored tables, and connected components."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the session has it; only where it is unset, and executors run here, one of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, tag: str, batch: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and a lost executor costs no recomputation.

    batch: rows that Python workers get at a time during this write, for rows that may be large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_ROWS)
    if batch:
        spark.conf.set(ARROW_ROWS, batch)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def let_go() -> None:
    """Give freed memory back to the system; idle Python workers would hold it beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def made_of_text(df: DataFrame, new: dict[str, tuple[T.DataType, pa.DataType]], make: Callable[[list[str | None]], dict[str, Any]], rows: int = 2048, end: Callable[[], None] = lambda: None) -> DataFrame:
    """df with the columns `new`, made of its texts, `rows` at a time; columns of these names are replaced.

    All other columns pass as Arrow arrays, untouched: whole numbers beside nulls stay what they are. end runs in a worker
    when its task ends, however it ends.
    """
    kept = df.drop(*[c for c in new if c != "text"]).columns
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    place, types = kept.index("text"), {c: arrow for c, (_, arrow) in new.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    made = make(part.column(place).to_pylist())
                    own = {c: pa.array(x, types[c]) for c, x in made.items()}
                    columns = [own.pop(c) if c == "text" and c in own else part.column(i) for i, c in enumerate(kept)]
                    yield pa.RecordBatch.from_arrays([*columns, *own.values()], names=[*kept, *own])
        finally:
            end()
            let_go()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(c, spark) for c, (spark, _) in new.items() if c != "text"]]))


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """Smallest id reachable from each linked id.

    links: (a long, b long), any order, self-links and repeats allowed, null ends ignored. Returns (id, component_id),
    one row per id that has a link to another id. Each round points every vertex at the neighbour (or itself) of least
    hash and contracts the links, so that chains shrink by a constant factor however their ids are ordered; all sums are
    pre-aggregated, and the driver sees only the number of links left.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = stored(edges, tag)
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("old"), F.least(F.col("m"), rank("a"))["v"].alias("new"))
        step = stored(step, tag)
        if labels is None:
            labels = step.select(F.col("old").alias("id"), F.col("new").alias("label"))
        else:
            labels = labels.join(step, labels["label"] == step["old"], "left").select("id", F.coalesce("new", "label").alias("label"))
        labels = stored(labels, tag)
        left = step.select(F.col("old").alias("a"), F.col("new").alias("x"))
        right = step.select(F.col("old").alias("b"), F.col("new").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), tag)
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    smallest = labels.groupBy("label").agg(F.min("id").alias("component_id"))
    return labels.join(smallest, "label").select("id", "component_id")


def one_vertex(links: DataFrame, rows: DataFrame, classes: DataFrame, key: str, tag: str) -> tuple[DataFrame, DataFrame]:
    """Make ids whose rows lie in several classes one vertex: links with those that takes, and (id, vertex) of such ids.

    rows: (id, key) of all rows, key null where a row has no class; classes: (key, first), the id that stands for a class.
    """
    named = rows.where("id is not null").withColumn("_mark", F.xxhash64(key))  # the same hash means the same class, or hardly ever not
    ids = named.groupBy("id").agg(F.min("_mark").alias("_low"), F.max("_mark").alias("_high")).where("_low <> _high").select("id")
    shared = stored(named.join(ids, "id").join(classes, key).select("id", "first").distinct(), f"{tag}-shared")
    least = stored(shared.groupBy("id").agg(F.min("first").alias("vertex")), f"{tag}-shared")
    more = shared.join(least, "id").where("first <> vertex").select(F.col("vertex").alias("a"), F.col("first").alias("b"))
    return links.select("a", "b").unionByName(more), least


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches cut so that no run of equal keys spans two."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        k = rest[keys].to_numpy()
        same = (k == k[-1]).all(axis=1)
        cut = len(rest) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield rest.iloc[:cut].reset_index(drop=True)
            rest = rest.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest
