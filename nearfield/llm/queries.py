"""The queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle import ORACLE_SQL  # noqa: F401

BPE = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE), limit=1024)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE), max_tokens=2048)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_leaks

    found = find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), min_repeat=10, max_share=0.3, max_repeat=100)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import co_train

    return co_train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), rounds=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), max_labelled=2000, landmarks=256)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_texts

    return score_texts(_table(spark, sf_dir, "documents"), modulus=10)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), n=5, percent=75)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), length=400)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of a tree source/thousand/hundred/id.txt; notices on short texts stand for licence files."""
    from .licenses import scan_licenses

    docs = _table(spark, sf_dir, "documents")
    folder = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"))
    short = (F.length("text") < 400) & F.col("text").contains("icense")
    path = F.concat_ws("/", folder, F.concat(F.when(short, "LICENSE.").otherwise(""), F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licenses(spark, docs.select("doc_id", path.alias("path"), "text"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_toxicity": op4_toxicity,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_license_scan": op10_license_scan,
}
