"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from badgewright.llm import (
    bagminhash,
    decontaminate,
    divergence,
    lexical,
    lines,
    packing,
    quality,
    resampling,
    simhash,
    style_tree,
    substrings,
    token_files,
    toxicity,
)
from badgewright.llm.oracle import ORACLE
from badgewright.llm.shared import raw

__all__ = ["ORACLE", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    read = token_files.token_files(raw(spark, sf_dir, "documents"), tokenizer, end_id=1, white_space="drop")
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge_documents(raw(spark, sf_dir, "documents"))


@query
def op3_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract_text(raw(spark, sf_dir, "pages"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(raw(spark, sf_dir, "documents"), raw(spark, sf_dir, "labels"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(raw(spark, sf_dir, "documents"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(raw(spark, sf_dir, "documents"), raw(spark, sf_dir, "labels"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(raw(spark, sf_dir, "documents"), tokenizer, end_id=0)


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats_report(raw(spark, sf_dir, "documents"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(raw(spark, sf_dir, "documents"), raw(spark, sf_dir, "benchmark"))


@query
def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_report(raw(spark, sf_dir, "documents"))


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_report(raw(spark, sf_dir, "documents"), raw(spark, sf_dir, "benchmark"))


@query
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampling_report(raw(spark, sf_dir, "documents"), raw(spark, sf_dir, "benchmark"))


@query
def op13_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_report(raw(spark, sf_dir, "documents"))
