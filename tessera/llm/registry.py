"""Queries of the training-data operators over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, decontamination, html_extraction, near_duplicates, packing, periodic_runs, quality, repeats, secret_scan, sharding, token_shards, url_rules, warc
from .common import read


def op1_dom_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(read(spark, sf_dir, "pages"))


def op2_lyndon_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find_repeats(read(spark, sf_dir, "documents")).drop("spans")


def op3_hamming_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.group_documents(read(spark, sf_dir, "documents"), k=3, percent=85)


def op4_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op5_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


def op6_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read(spark, sf_dir, "documents"))


def op7_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.materialize_order(read(spark, sf_dir, "documents"))


def op10_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(read(spark, sf_dir, "documents"))


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.report(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op12_trie_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(read(spark, sf_dir, "conversations"))


def op13_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report_runs(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_feistel_sharding": sharding.oracle(),
        "op5_fm_index_decontamination": decontamination.oracle(),
        "op6_adaptive_quality": quality.oracle(),
        "op10_ownership_secrets": secret_scan.oracle(),
        "op11_url_rules": url_rules.oracle(),
        "op12_trie_repair": conversation_repair.oracle(),
    }
