"""The corpus pipeline: five stages that each read what the one before kept.

Quality rules drop repetitive documents, line dedup takes out lines found in many documents, the n-gram join keeps one document of
each near-duplicate group, mixing emits documents as often as the target weights take them, and packing cuts them into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from tapeflow.session import checkpoint_dir, prepare


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go."""
    return quality_rules.keep_good(docs)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: texts lose lines that stand in many documents; n_chars follows the text."""
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram join: one document of each near-duplicate group stays."""
    return ngram_join.without_duplicates(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as the target weights take it."""
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of sequences with their token ids."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", distinct_lines),
    ("ngram_join", distinct_documents),
    ("mixing", mixed_documents),
    ("packing", packed_sequences),
]

#: SQL has neither the tokenizer nor the suffix arrays; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; each result is written and read again."""
    folder = f"{checkpoint_dir(prepare(spark))}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
