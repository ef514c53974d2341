"""A corpus from raw documents: quality rules, line dedup, near-dedup, mixing by source, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, in the columns of
``documents``; the last one returns a row of token figures per document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tugboard.llm import bpe_codec, line_dedup, mixing, quality_rules, simhash_dedup
from tugboard.llm.queries import TOKENIZERS
from tugboard.session import ensure_checkpoint_dir


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, from hosts that are not rejected."""
    return quality_rules.quality_rules(docs, with_documents=True)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one has."""
    counts = ("n_lines_before", "n_lines_dropped")
    return line_dedup.drop_repeated_lines(docs, counts=counts).drop(*counts)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_dedup.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix takes."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, and what they decode to."""
    return bpe_codec.round_trip(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


STAGES = [
    ("quality rules", judge_quality),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("bpe encoding", encode),
]

# Hashes, pseudorandom draws and merges have no SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read by the next."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
