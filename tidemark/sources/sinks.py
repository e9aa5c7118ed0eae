"""Writing trades, reports, vectors and entity tables."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRADE_COLUMNS = ("symbol", "side", "entry", "stop", "exit", "unstopped_exit", "entry_time", "exit_time", "size", "profit", "value_before", "value_after")


def write_trades_csv(trades: DataFrame, path: str) -> None:
    trades.select(*TRADE_COLUMNS).write.option("header", True).csv(path)


def files_of(spark: SparkSession, path: str) -> tuple[Any, Callable[[str], Any]]:
    """The file system of a path, wherever it is, and names as its paths."""
    named = spark._jvm.org.apache.hadoop.fs.Path
    return named(path).getFileSystem(spark._jsc.hadoopConfiguration()), named


def store_append(rows: DataFrame, path: str, batch: str, by: str | None = "run_id") -> bool:
    """Append rows to a store (a folder an entity type) as one batch, partitioned by run (or not, by=None); whether they were new.

    Files go to a folder of their own first; a manifest that names it, put in place by a rename, makes them part of the store.
    A batch whose manifest is there is not written again, and files of a write that broke off are never read. A batch has
    one writer at a time, as a retried job or trigger has.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch):
        raise ValueError(f"a batch is named by letters, digits, dots and dashes, not {batch!r}")
    files, named = files_of(rows.sparkSession, path)
    manifest = named(f"{path}/manifests/{batch}")
    if files.exists(manifest):
        return False
    folder = f"{batch}-{uuid.uuid4().hex}"
    (rows.write.partitionBy(by) if by else rows.write).parquet(f"{path}/data/{folder}")
    draft = named(f"{path}/drafts/{folder}")
    out = files.create(draft, True)
    try:
        out.write(folder.encode())
    finally:
        out.close()
    files.mkdirs(manifest.getParent())
    return bool(files.rename(draft, manifest))


def store_read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches of a store that were appended whole; schema names the store's columns, that of its folders among them."""
    files, named = files_of(spark, path)
    kept = f"{path}/manifests"
    if not files.exists(named(kept)) or not files.listStatus(named(kept)):
        return spark.createDataFrame([], schema)
    found = [f"{path}/data/{r[0]}" for r in spark.read.text(kept).collect()]  # one name an append
    parts = [spark.read.schema(schema).parquet(f) for f in found]
    return functools.reduce(DataFrame.unionByName, parts).select(*schema.fieldNames())


def save_report(report: DataFrame, path: str, run_id: str) -> None:
    report.withColumn("run_id", F.lit(run_id)).write.mode("append").json(path)


def vector_text(x: str) -> Column:
    return F.array_join(F.transform(x, lambda v: v.cast("string")), "\t")


def parse_vector(x: str) -> Column:
    return F.transform(F.split(x, "\t"), lambda v: v.cast("double"))


def save_vectors(df: DataFrame, path: str) -> None:
    df.write.option("compression", "lz4").parquet(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
