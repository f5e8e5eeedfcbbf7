"""A training-data pipeline over ``documents``: each stage takes the table that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents. Each takes null
and empty texts, null languages and sources, repeated rows, empty tables and more columns of any name; what it then returns is in the
docstring of the operator that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, near_duplicates, packing, quality, secret_scan
from tessera.llm.common import bound_batches, materialize, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive limits of their language and source."""
    bound_batches(spark)
    return quality.keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group (five words, similarity 0.8)."""
    bound_batches(spark)
    return near_duplicates.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that hold windows of benchmark items."""
    return decontamination.remove_passages(docs, read(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets (all but tokens of many owners' or repositories' own texts, which are examples) replaced by a mark."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence, with its ids (uint32, little-endian): the training data."""
    bound_batches(spark)
    return packing.pack_documents(docs, with_ids=True)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("benchmark_decontamination", benchmark_decontamination), ("secret_scans", secret_scans), ("packing", pack)]

#: Confirmed MinHash links, an FM-index and tokenizer ids have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
