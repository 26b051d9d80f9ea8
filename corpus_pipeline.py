"""The corpus pipeline: language, repeated lines, near duplicates, leaked benchmark items, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
`documents`. A stage's result is written as Parquet and read again before the next one.

In every stage a null text counts as an empty one, texts are read whole whatever their length, columns
beyond those of `documents` are left behind, and an empty table gives an empty one. Repeated rows stay or go
together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasforge.llm import bpe, decontam, langid, linededup, setjoin
from atlasforge.llm.common import documents, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the languages of `lang`; those that the model rejects go, as do
    texts without a letter."""
    model = langid.learn(docs, F.lit(True))
    return langid.identify(docs.select(*COLUMNS), model).where(~F.col("rejected")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line matches; a document that is left without a word by
    that goes. Lines go by a row's id and their place in its text, so rows that share an id, or have none, lose
    the same places."""
    left = linededup.dedup_lines(docs.select(*COLUMNS)).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates. Rows that share an id are one
    document: they stay or go together, and go if any of them has a near duplicate with a smaller id. A
    document without words is near to nothing and stays, and so does a row without an id."""
    groups = setjoin.link_groups(docs)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
    return docs.select(*COLUMNS).join(gone, F.col("doc_id") == F.col("gone"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontam.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, and hashes of ids and decoded text."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", tokenize),
]
#: SQL can't express the stages at whole-table size; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from `documents`."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
