"""Texts in Arrow batches, cut to blocks of about equal bytes; long texts cut at places the caller knows to be safe."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.shared import let_go

#: Bytes of text that are worked on at once, and rows of counts that a task holds before it passes them on.
BLOCK, HELD = 1 << 22, 1 << 19


def pieces(text: str, safe: re.Pattern[str], size: int) -> Iterator[str]:
    """A text in parts of at least `size` characters, each but the first beginning at a match of `safe`; together they are the text."""
    at = 0
    while len(text) - at > size and (found := safe.search(text, at + size)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def blocks(texts: pa.Array, safe: re.Pattern[str], size: int = BLOCK) -> Iterator[tuple[int, int, Iterator[tuple[pa.Array, np.ndarray]]]]:
    """Rows start..end of about `size` bytes, and their texts as (array, row of each): one array, or several parts of one long text.

    A row longer than `size` is a block of its own and comes in parts of about `size` bytes. texts: strings without nulls.
    """
    length = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    start = 0
    while start < len(texts):
        end = start + max(1, int(np.searchsorted(np.cumsum(length[start : start + 65536]), size, side="right")))
        own = texts.slice(start, end - start)
        if length[start] > size:
            cut = pieces(texts[start].as_py(), safe, size)
            yield start, end, ((pa.array([x], pa.string()), np.zeros(1, np.int64)) for x in cut)
        else:
            yield start, end, iter([(own, np.arange(end - start))])
        start = end


def partial_counts(df: DataFrame, count: Callable[[pa.RecordBatch, int], Iterator[pa.Table]], keys: list[str], sums: list[str], schema: str) -> DataFrame:
    """What count makes of df's batches and a block's size (columns keys and sums), summed by keys inside each task: it passes on HELD rows at a time at most."""
    size, most = BLOCK, HELD

    def merged(tables: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([(c, "sum") for c in sums])
        return out.select([*keys, *[f"{c}_sum" for c in sums]]).rename_columns([*keys, *sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        try:
            for batch in batches:
                for table in count(batch, size):
                    held.append(table)
                    if sum(t.num_rows for t in held) > most:
                        held = [merged(held)]
                        if held[0].num_rows > most // 2:
                            yield from held.pop().to_batches(65536)
            if held:
                yield from merged(held).to_batches(65536)
        finally:
            let_go()

    return df.mapInArrow(run, schema)
