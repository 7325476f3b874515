"""The corpus pipeline: quality rules, near-duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept. All but
the last return the columns of ``documents``; the last returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierweave.llm import packing, pii, quality, simhash
from tierweave.llm.common import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose perplexity lies within their language's bands.

    Null and empty texts go; rows that repeat an id stay if any of them is kept; all columns stay.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; all columns stay.

    Of rows that repeat that id, one with the smallest hash of its text stays; rows without an id stay only where a group has no id.
    """
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data in their texts replaced by its kind; null texts stay null, all columns stay."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in its sequence; a null or empty text is the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("PII redaction", personal_data),
    ("best-fit packing", pack_sequences),
]

#: Perplexity bands, boosted trees and the packing plan are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
