"""The queries of this package, by name, and the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core, mixing


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_array_dedup

    core.tune(spark)
    out = suffix_array_dedup(core.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_phrase_dedup

    core.tune(spark)
    out = repeated_phrase_dedup(core.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    core.tune(spark)
    out = toxicity_scores(core.table(spark, sf_dir, "documents"), core.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    core.tune(spark)
    out = license_scan(core.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.col("all_labels").alias("labels"), "score", F.col("labels").alias("clearest_labels"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_classes

    core.tune(spark)
    return jaccard_classes(core.table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import FLOOR, importance_resample

    core.tune(spark)
    out = importance_resample(core.table(spark, sf_dir, "documents"), core.table(spark, sf_dir, "labels"), floor=FLOOR)
    return out.select("doc_id", "n_grams", "log_weight", "key", "kept")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(core.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import benchmark_decontamination

    core.tune(spark)
    out = benchmark_decontamination(core.table(spark, sf_dir, "documents"), core.table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return out.select(F.col("did").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), "contaminated")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multi_index import embedding_near_dedup

    core.tune(spark)
    return embedding_near_dedup(core.table(spark, sf_dir, "embeddings"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_scan

    out = secret_scan(core.table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "start", "n_chars", F.sha2("value", 256).alias("value_sha256"), "score", "secret")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_quality": op5_quality,
    "op6_mix_sources": op6_mix_sources,
    "op7_decontamination": op7_decontamination,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE: dict[str, str] = {"op6_mix_sources": mixing.ORACLE}
