"""The thin queries over the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fm_index, jaccard_join, katz, license_scan, mixing, pii, quality, substring_dedup, tiff, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_docs(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_docs(spark, sf_dir))


def op3_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.contamination_digest(fm_index.find_contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_docs(spark, sf_dir))


def op5_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_docs(spark, sf_dir))


def op6_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_docs(spark, sf_dir))


def op8_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(_docs(spark, sf_dir))


def op9_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(_docs(spark, sf_dir))


def op10_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_docs(spark, sf_dir), _labels(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_fm_decontamination": op3_fm_decontamination,
    "op4_pivotal_mix": op4_pivotal_mix,
    "op5_pii_boosting": op5_pii_boosting,
    "op6_quality_rff": op6_quality_rff,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_katz_scores": op8_katz_scores,
    "op9_tiff_media": op9_tiff_media,
    "op10_toxicity_ordinal": op10_toxicity_ordinal,
}

ORACLES: dict[str, str] = {"op1_license_scan": license_scan.oracle(), "op2_substring_dedup": substring_dedup.oracle(), "op3_fm_decontamination": fm_index.oracle()}
