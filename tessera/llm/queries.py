"""Registered queries of the training-data operators (``opN_<name>``), each over its whole
intended table with production parameters.  Only the ranked search has oracle SQL: sketches,
trained models, tokenizers, tries, packings, runs and hundreds of regular expressions have no
SQL form, and the two removal / join contracts are too slow in SQL on whole tables;
``tests/llm`` holds each against brute force, an exact round trip or held-out accuracy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    curves,
    fingerprints,
    jaccard,
    language,
    lexical,
    licenses,
    logbilinear,
    mixing,
    packing,
    periods,
    substrings,
    token_counts,
    toxicity,
)
from .common import shared_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_documents(spark, sf_dir))


def op5_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every call starts from an empty cache, so its work is that of a cold start
    return token_counts.count_tokens(_documents(spark, sf_dir), shared_path(spark, "token-cache"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logbilinear.score(_documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_documents(spark, sf_dir))


def op9_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(_documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_report(periods.with_planted_run(_documents(spark, sf_dir)))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_documents(spark, sf_dir))


def op13_shared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _documents(spark, sf_dir))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_curve_neighbours": op5_curve_neighbours,
    "op6_token_counts": op6_token_counts,
    "op7_lm_scores": op7_lm_scores,
    "op8_language": op8_language,
    "op9_jaccard_groups": op9_jaccard_groups,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_license_scan": op12_license_scan,
    "op13_shared_search": op13_shared_search,
}
ORACLE: dict[str, str] = {"op13_shared_search": lexical.ORACLE_SQL}
