"""Queries of the text operators over their whole tables, with check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeflow.llm import (
    alignment,
    decontamination,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    spelling,
    suffix_dedup,
    token_counts,
    vector_join,
)
from tapeflow.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def over(name: str, tables: str, digest: Callable[..., DataFrame], sql: str | None = None) -> None:
    """Register ``digest`` of whole tables as a query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return digest(*(prepare(spark).read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()))

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


over("op1_ngram_join", "documents", ngram_join.digest, ngram_join.SQL)
over("op2_suffix_dedup", "documents", suffix_dedup.digest, suffix_dedup.SQL)
over("op3_token_counts", "documents", token_counts.digest)
over("op4_quality_classifier", "documents labels", quality_classifier.digest)
over("op5_embedding_near_dedup", "embeddings", vector_join.digest, vector_join.SQL)
over("op6_line_dedup", "documents", line_dedup.digest, line_dedup.SQL)
over("op7_mixing", "documents", mixing.digest, mixing.SQL)
over("op8_language_id", "documents", language_id.digest)
over("op9_packing", "documents", packing.digest)
over("op10_quality_rules", "documents", quality_rules.digest, quality_rules.SQL)
over("op11_spelling_variants", "documents", spelling.digest)
over("op12_decontamination", "documents benchmark", decontamination.digest, decontamination.SQL)
over("op13_alignment", "documents", alignment.digest)
