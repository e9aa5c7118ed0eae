"""Numbers of tokens, as the library of a vocabulary file counts them: batch encoding in Arrow functions that return lengths only.

Texts are taken in blocks of about equal bytes; a longer text is cut at safe boundaries, where the library's tokens of both
sides are its tokens of the whole. At the same boundaries all texts fall into units, each distinct unit of a block is
encoded once, in batches of about equal bytes, and only lengths come back and are summed by text. Which boundaries are safe
follows from the file:

* .json that splits words by WORDS after NFC, lower-casing and white space folded: at ASCII white space, which is dropped and
  never composes; units over LONG also before and after ASCII digits, which are tokens by themselves, and between an ASCII
  letter and an ASCII sign. The sign | is left out, as special strings of such files hold it, and no special string may
  hold white space or a digit (checked).
* .json of byte-level kind without a normaliser: before a single space between two ASCII letters or digits (the space goes
  with what follows).
* .model that puts a space before a text and keeps runs of spaces: the same, and the space itself goes, as the library puts one
  before each unit; only where no piece holds a space after something else (checked).
* any other .json: nowhere; texts are encoded whole. Any other .model raises ValueError.

Special strings inside a text are what the library makes of them by default. A run without a safe boundary is encoded whole.

Defined results: null and empty texts have 0 bytes and 0 tokens; null ids, repeated rows and shared ids are rows like any
other; columns named as the new ones are replaced, others pass; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.pieces import blocks, pieces
from tidemark.llm.shared import let_go

LIMIT = 2048
#: Characters of a unit that is cut further and not remembered; bytes of units encoded at a time; bytes of units remembered.
LONG, BATCH, KNOWN = 4096, 1 << 18, 1 << 27
#: The split of words that the finer boundaries were derived from (a fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = re.compile(r"[\x20\x09-\x0D]")
INNER = re.compile(r"(?<=[0-9])(?=[!-{}~])|(?<=[!-~])(?=[0-9])|(?<=[A-Za-z])(?=[!-/:-@\[-`{}~])")
EITHER = re.compile(rf"{SPACE.pattern}|{INNER.pattern}")
ALONE = re.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z0-9])")
NOWHERE = re.compile(r"(?!)")


class Lengths:
    """Numbers of tokens by unit, and where units may be cut. kind: words, spaces (before a single space), pieces (at one), whole."""

    def __init__(self, path: str):
        self.encode, self.kind = library(path)
        self.safe = {"words": EITHER, "spaces": ALONE, "pieces": ALONE, "whole": NOWHERE}[self.kind]
        self.known: dict[str, int] = {}
        self.room = KNOWN

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Units of the texts, and which text each is of."""
        if self.kind == "words":
            lists = pc.ascii_split_whitespace(texts)
            return pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        cut = [ALONE.split(t) if self.kind != "whole" else [t] for t in texts.to_pylist()]
        flat = [x[1:] if self.kind == "pieces" and i else x for own in cut for i, x in enumerate(own)]
        return pa.array(flat, pa.string()), np.repeat(np.arange(len(cut)), [len(x) for x in cut])

    def lengths(self, units: list[str]) -> np.ndarray:
        out = np.fromiter((self.known.get(u, -1) for u in units), np.int64, len(units))
        new = [int(i) for i in np.flatnonzero(out < 0)]
        parts = [list(pieces(units[i], INNER, LONG)) if self.kind == "words" else [units[i]] for i in new]
        flat = [x for own in parts for x in own]
        size = np.cumsum([len(x) for x in flat]) // BATCH
        got = np.zeros(len(flat), np.int64)
        for at in (np.split(np.arange(len(flat)), np.flatnonzero(np.diff(size)) + 1) if flat else []):
            got[at] = self.encode([flat[k] for k in at])
        end = 0
        for i, own in zip(new, parts, strict=True):
            out[i] = got[end : end + len(own)].sum()
            end += len(own)
            self.remember(units[i], int(out[i]))
        return out

    def remember(self, unit: str, n: int) -> None:
        if len(unit) <= LONG:
            self.room -= 150 + 4 * len(unit)
            if self.room < 0:
                self.known.clear()
                self.room = KNOWN
            self.known[unit] = n

    def count(self, texts: pa.Array, rows: np.ndarray, out: np.ndarray) -> None:
        """Add to out, by row, the tokens of the texts."""
        units, of = self.units(texts)
        coded = units.dictionary_encode()
        n = self.lengths(coded.dictionary.to_pylist())
        np.add.at(out, rows[of], n[coded.indices.to_numpy()])


def library(path: str) -> tuple[Callable[[list[str]], list[int]], str]:
    """The library's batch encoding as lengths, and the kind of boundaries that are safe for this file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = model.encode("x  y") == [*model.encode("x"), *model.encode(" y")]  # runs of spaces stay, a space goes before
        inner = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
        if not plain or inner:
            raise ValueError(f"{path}: no boundary of this model is known to be safe")
        return lambda units: [len(x) for x in model.encode(units, num_threads=1)], "pieces"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        named = json.load(f)
    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()
    special = named.get("added_tokens") or []
    free = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"[\s0-9]", t["content"]) for t in special)
    split, folds = named.get("pre_tokenizer") or {}, (named.get("normalizer") or {}).get("normalizers", [])
    patterns = [x.get("pattern", {}).get("Regex") for x in split.get("pretokenizers", [])]
    kind = "whole"
    if free and patterns[:1] == [WORDS] and [f["type"] for f in folds] == ["NFC", "Replace", "Lowercase"]:
        kind = "words"
    elif free and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not named.get("normalizer"):
        kind = "spaces"
    return lambda units: [len(x) for x in tool.encode_batch_fast(units, add_special_tokens=False)], kind


@functools.lru_cache(maxsize=2)
def lengths_of(path: str) -> Lengths:
    return Lengths(path)


def with_counts(df: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """df (text, ...) with n_bytes, n_tokens and over_limit (n_tokens > limit), by the vocabulary file at path."""
    new = ["n_bytes", "n_tokens", "over_limit"]
    kept = df.drop(*[c for c in new if c != "text"]).columns
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    place = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lengths_of(path)
        try:
            for batch in batches:
                texts = pc.fill_null(batch.column(place), "")
                tokens = np.zeros(len(texts), np.int64)
                for start, end, parts in blocks(texts, own.safe):
                    for first, part in enumerate(parts):
                        cut = first and own.kind == "pieces"  # later parts begin with the space they were cut at
                        own.count(pa.array([x[1:] for x in part[0].to_pylist()], pa.string()) if cut else part[0], part[1], tokens[start:end])
                added = [pc.cast(pc.binary_length(texts), pa.int64()), pa.array(tokens), pa.array(tokens > limit)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*kept, *new])
        finally:
            let_go()

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (doc_id, text, ...)."""
    return with_counts(docs.select("doc_id", "text"), path, limit).drop("text")
