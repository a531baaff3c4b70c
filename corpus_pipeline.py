"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage's result is
written as Parquet in the shared folder and read back as the next one's input.

Defined results: a null text or one without a letter goes in the first stage, so no later stage sees it; very long texts are read whole. Of repeated rows
and ties of near duplicates the smallest id stays, and of rows that repeat it one; rows with a null id all stay, though links go through them.
Other columns stay as they are, whatever their names; n_chars is counted anew where a text changes. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import read_table, staged
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.language_id import keep_identified
from graphloom.llm.packing import pack
from graphloom.llm.secrets_scan import redact
from graphloom.llm.simhash import keep_one


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of test items; those that are test items for the most part go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets struck out."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, with their token ids."""
    return pack(docs, keep_ids=True, remember=150_000)  # the workers of earlier stages hold memory, too


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("secret_scan", secrets),
    ("packing", packing),
]

#: SQL can't express the language model's decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = staged(docs, name)
    return docs
