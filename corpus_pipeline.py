"""A pipeline over documents: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of documents, whatever further columns there are.

Defined results, for every stage: an empty table gives an empty one; a null text counts as empty; a row without an id is a
document like any other; texts are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from badgewright.llm import bagminhash, decontaminate, lines, packing, toxicity
from badgewright.llm.shared import raw
from badgewright.sources.files import materialised


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go; it learns from the labels of those that came.

    Repeated rows are judged alike. Without labels of both kinds nothing is learned, and only a share of toxic labels of
    a half or more rejects anything.
    """
    return toxicity.drop_toxic(docs, raw(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; the number of characters follows the text.

    All rows stay, with what is left of their texts, which may be empty. Rows of one id are one document and keep the lines
    they share; the null id comes after all others.
    """
    kept = lines.dedup_lines(docs)
    columns = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return kept.select(*[columns[c].alias(c) if c in columns else F.col(f"row.`{c}`") for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies stays.

    Rows equal in id and text are one document, of which one row stays; rows of one id with different texts are different
    documents. A text without words is a group of its own; the null id comes after all others.
    """
    return bagminhash.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. Each row is judged by itself; a text without words is clean."""
    return decontaminate.decontaminated(docs, raw(spark, sf_dir, "benchmark"))


def as_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens. Every row has at least the end id."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", as_sequences),
]

# SQL cannot learn the toxicity model; the tests hold the result against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
