"""Registered queries of this subpackage: one ``opN_<name>`` for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import conversations, credentials, embeddings, kneser, langid, lines, lm, negatives, packing, pieces, quality, simhash, warc


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy removes, over the ledger of operator 4."""
    return quality.ablation_report(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_piece_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return kneser.report(spark, read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/labels.parquet"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_credential_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.report(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_lm_scoring,
        op3_simhash_near_dedup,
        op4_quality_rules,
        quality_ablations,
        op5_best_fit_packing,
        op6_line_dedup,
        op7_piece_segmentation,
        op8_language_id,
        op9_warc_derivatives,
        op10_quality_classifier,
        op11_conversation_trie,
        op12_hard_negatives,
        op13_credential_scan,
    )
}

ORACLES: dict[str, str] = {"op4_quality_rules": quality.SQL, "quality_ablations": quality.ABLATIONS_SQL, "op6_line_dedup": lines.SQL, "op13_credential_scan": credentials.SQL}
