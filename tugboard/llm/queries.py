"""The registered queries of these operators, each over its whole table with production parameters."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tugboard.llm import bpe_codec, embedding_dedup, katz_lm, line_dedup, merkle_manifest, mixing, prefix_free_dedup, prefix_trie, quality_rules, simhash_dedup, token_output, url_filters, warc_archives
from tugboard.llm.url_filters import GivenRule
from tugboard.session import ensure_checkpoint_dir

# Where the vocabulary files of public tokenizers lie; every executor needs them there.
TOKENIZERS = os.environ.get("TUGBOARD_TOKENIZERS", "/opt/tokenizers")

# The rules that url verdicts start from.
URL_RULES = [
    GivenRule("allow", "org", "/"),
    GivenRule("block", "example.org", "/es/"),
    GivenRule("block", "example.org", "/en/1"),
    GivenRule("allow", "com", "/fr/"),
    GivenRule("block", "com", "/de/"),
]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_free_dedup.remove_repeats(_documents(spark, sf_dir))
    removed = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda total, x: total + x)
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("begins").cast("bigint").alias("n_spans"), "kept_sha256"
    )


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(_documents(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.json")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(_documents(spark, sf_dir))


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4()}"
    token_output.write_tokens(_documents(spark, sf_dir), folder, token_output.TokenRule(f"{TOKENIZERS}/word_bpe_49k.json"))
    return token_output.read_tokens(spark, folder, with_ids=False)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return url_filters.filter_urls(pages, labels, URL_RULES)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_documents(spark, sf_dir)).drop("source", "host_rate")


def op10_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_lm.katz_scores(_documents(spark, sf_dir), rule=katz_lm.KatzRule(order=3))


# What a leaf of the manifest covers, in this order, and the letters that tampering lower-cases.
MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(_crc("doc_id") % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    made = merkle_manifest.manifest(_documents(spark, sf_dir), "doc_id", "lang", MANIFEST_FIELDS, {"text": tampered})
    return merkle_manifest.verified(made)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = prefix_trie.paths_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(paths, (_crc("conv_id") % 6).cast("int")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4()}"
    warc_archives.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return warc_archives.read_archives(spark, folder).where(F.col("gap").isNull()).select(
        F.expr("try_cast(record_id as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.expr("try_cast(refers_to as bigint)").alias("refers_to"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_suffix_array_dedup, op2_bpe_codec, op3_embedding_near_dedup, op4_simhash_near_dedup,
        op5_token_id_output, op6_source_mixing, op7_line_dedup,
        op8_url_filters, op9_quality_rules, op10_katz_lm, op11_merkle_manifest, op12_conversation_trie,
        op13_warc,
    )
    return {query.__name__: query for query in every}
