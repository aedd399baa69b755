"""A training-corpus pipeline over `documents`: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from textlens.llm import bpe, decontaminate, jaccard, language_id, repeats
from textlens.llm._common import scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the languages from the labelled documents and drops what fits none: texts that are null, without a letter, or
    far from every learned language."""
    model = language_id.train(docs)
    return language_id.identify(docs, model).where(~F.col("rejected")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near copies (5-word shingles, similarity 0.8 or more)."""
    return jaccard.keep_one(docs).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte of a 100-byte string that stands earlier; documents of which nothing is left go."""
    cut = repeats.remove_repeats(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document in which 10 words in a row of a benchmark item occur."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("byte_bpe", tokens),
]

#: Suffix arrays, models and merges have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
