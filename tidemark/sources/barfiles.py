"""Text bar files as a Spark data source: a partition a file; symbols that aren't asked for keep their files closed.

Symbols and dates are options, not filters pushed by the planner: Spark (4.1) keeps filters pushed to a Python source with the
table, so that a plan with the same table twice, each time filtered otherwise, would read what the last filter left.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as csv
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint"
#: Columns of a file, without a header: `yyyyMMdd;open;high;low;close;volume`.
FILE = {"day": pa.string(), "open": pa.float64(), "high": pa.float64(), "low": pa.float64(), "close": pa.float64(), "volume": pa.int64()}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; without a scheme, or with file:, the local one."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path


def symbol_of(path: str) -> str:
    """That of the folder (symbol=...), else the file's stem."""
    folder, _, name = path.rpartition("/")
    last = folder.rpartition("/")[2]
    return unquote(last.removeprefix("symbol=") if last.startswith("symbol=") else name.rpartition(".")[0] or name)


@dataclass
class BarFile(InputPartition):
    path: str
    symbol: str


class BarReader(DataSourceReader):
    """options: path; symbols, a JSON list; start and end, inclusive days (yyyy-mm-dd)."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.names = options["path"], schema.fieldNames()
        self.symbols = set(json.loads(options["symbols"])) if "symbols" in options else None
        day = lambda name: pa.scalar(dt.datetime.fromisoformat(options[name]), pa.timestamp("us")) if name in options else None
        self.start, self.end = day("start"), day("end")

    def partitions(self) -> list[BarFile]:
        files, base = opened(self.path)
        inside = files.get_file_info(fs.FileSelector(base, recursive=True)) if files.get_file_info(base).type == fs.FileType.Directory else [files.get_file_info(base)]
        kept = [x.path for x in inside if x.type == fs.FileType.File and x.size and not x.path[len(base) :].lstrip("/").startswith(("_", ".")) and "/_" not in x.path[len(base) :] and "/." not in x.path[len(base) :]]
        found = [BarFile(p, symbol_of(p)) for p in sorted(kept)]
        return [f for f in found if self.symbols is None or f.symbol in self.symbols]

    def read(self, partition: BarFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where no file is left
            return
        files, _ = opened(self.path)
        with files.open_input_stream(partition.path) as stream, csv.open_csv(
            stream, csv.ReadOptions(column_names=list(FILE)), csv.ParseOptions(delimiter=";"), csv.ConvertOptions(column_types=FILE, strings_can_be_null=True)
        ) as batches:
            for batch in batches:
                ts = pc.strptime(batch.column("day"), format="%Y%m%d", unit="us", error_is_null=True)
                own = {"symbol": pa.array([partition.symbol] * len(batch), pa.string()), "ts": ts} | {c: batch.column(c) for c in FILE if c != "day"}
                out = pa.RecordBatch.from_arrays([own[c] for c in self.names], names=self.names)
                if self.start is not None:
                    out = out.filter(pc.greater_equal(out.column("ts"), self.start))
                if self.end is not None:
                    out = out.filter(pc.less_equal(out.column("ts"), self.end))
                yield out


class BarFiles(DataSource):
    """spark.read.format("bar_files").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "bar_files"

    def schema(self) -> str:
        return BAR

    def reader(self, schema: StructType) -> BarReader:
        return BarReader(self.options, schema)


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of the text files below a folder, or of one file: of some symbols only, and of days from start to end."""
    spark.dataSource.register(BarFiles)
    asked = {"symbols": None if symbols is None else json.dumps(symbols), "start": start, "end": end}
    return spark.read.format("bar_files").options(**{k: v for k, v in asked.items() if v is not None}).load(path)
