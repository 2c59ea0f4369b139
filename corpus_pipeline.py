"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage works on all that the one before it kept. All but the last return the columns of
documents, whatever these are beside doc_id, text and source. What a stage writes on its way, and its
predecessor's result, is deleted once its own result is written.

Defined cases, for every stage: null text is empty; very long texts are worked on whole; repeated rows
are judged alike; rows without doc_id go through all stages; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.common import delete, fresh_path, scratch
from tracewell.llm.minhash import without_near_duplicates
from tracewell.llm.mixing import copies
from tracewell.llm.packing import packed
from tracewell.llm.quality_rules import kept_documents
from tracewell.llm.secrets_scan import without_secrets
from tracewell.llm.token_files import default_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null and empty texts are among them."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest doc_id stays.

    Rows without doc_id, and texts without words, stay.
    """
    return without_near_duplicates(docs, size=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; every document stays, null texts as null."""
    return without_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole, in training order; texts without words are not taken."""
    return copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its sequence and its place there."""
    return packed(docs, default_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mixing", mixing),
    ("packing", packing),
]

#: Expectation-maximisation, hashing and tokenizing have no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
