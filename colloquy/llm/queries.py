"""Queries over the driver's tables, one for each operator of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate, language_id, line_chunks, packing, periodic_runs, pii_weak, quality_llr, secret_scan, simhash_trie, suffix_dedup, target_encoding, toxicity_fst, warc_segments,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_sparse_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.query(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(_table(spark, sf_dir, "documents"))


def op4_secret_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.query(_table(spark, sf_dir, "documents"))


def op5_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.query(_table(spark, sf_dir, "documents"))


def op7_toxicity_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fst.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.query(_table(spark, sf_dir, "documents"))


def op9_pii_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_weak.query(_table(spark, sf_dir, "documents"))


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_segments.query(_table(spark, sf_dir, "pages"))


def op11_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_encoding.query(*(_table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.query(_table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.query(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op10_warc_segments": warc_segments.SQL, "op11_target_encoding": target_encoding.SQL}
