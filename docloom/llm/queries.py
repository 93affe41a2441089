"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontam, embeddings, htmlextract, linedup, mixing, quality, secrets, simhash, substring, tokencount
from docloom.llm.runtime import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.run(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.run(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.run(read_table(spark, sf_dir, "documents"))


def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.run(read_table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.run(read_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.run(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.run(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.run(read_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.run(read_table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.run(read_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it stands on this subpackage, so it is imported when it runs

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "pipeline": pipeline,
        "op1_quality": op1_quality,
        "op2_token_counts": op2_token_counts,
        "op3_line_dedup": op3_line_dedup,
        "op4_repeated_substrings": op4_repeated_substrings,
        "op5_html_text": op5_html_text,
        "op6_decontamination": op6_decontamination,
        "op7_mixing": op7_mixing,
        "op8_simhash": op8_simhash,
        "op9_secrets": op9_secrets,
        "op10_embeddings": op10_embeddings,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": linedup.SQL, "op7_mixing": mixing.SQL}
