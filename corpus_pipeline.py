"""A training-data pipeline over `documents`: language, near duplicates, personal data, mixing, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs; all but the last return the columns of documents. Each works on all that its predecessor kept:

language         drops documents whose language can't be told (no text, no letter, or two codewords equally near)
near_duplicates  keeps one row, one with the smallest doc_id, of each group of near duplicates and of repeated rows
personal_data    replaces e-mail and IP addresses, card and phone numbers by their kind in angle brackets
mix              takes texts by source weights: whole, as often as their words are taken, and contiguous runs of words
tokens           encodes each text and decodes it again: ids, their number, and whether the decoded text is the text

Nulls, empty tables, repeated rows, rows that share an id, very long texts: each stage does what its operator's docstring
says. A null doc_id is one document a row and stays null; a null lang isn't learned from; a null source is a source; a null
text ends in the first stage (given to a later one, it has no duplicate, no personal data, no words to mix and no ids).
Other columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.langid import accepted
from tidemark.llm.minhash import deduplicated
from tidemark.llm.mixing import mixed_texts
from tidemark.llm.pii import redacted
from tidemark.llm.queries import piece_model
from tidemark.llm.shared import stored
from tidemark.llm.tokens import with_ids

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_texts(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = with_ids(docs.select("doc_id", "lang", "source", "text"), piece_model())
    same = F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False))
    return found.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("tokens", tokens)]

#: SQL can't express a learned classifier or BPE: tests/llm/test_brute_force.py holds each stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
