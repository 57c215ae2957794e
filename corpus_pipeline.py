"""A corpus pipeline of five stages over documents, each stage over all that the one before kept.

run(spark, sf_dir) chains the stages in one process; a driver may also write each
stage's result and read it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import core
from rasterloom.llm.decontaminate import benchmark_decontamination
from rasterloom.llm.jaccard import jaccard_classes
from rasterloom.llm.mixing import mix_sources
from rasterloom.llm.quality import FLOOR, importance_resample
from rasterloom.llm.secrets import mask_secrets, secret_scan

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the importance sample for the good label; the others go.

    A null or empty text has log weight 0; a null doc_id has no label; rows that share a doc_id are each judged by their
    own text; ties at the edge of the sample stay; no labels: all stay; an empty table stays empty; other columns go.
    """
    core.tune(spark)
    scored = importance_resample(docs.select(*COLUMNS), core.table(spark, sf_dir, "labels"), floor=FLOOR)
    return scored.filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that n-gram Jaccard links connect, the one with the smallest doc_id.

    Links are Jaccard similarities of 0.8 at least over runs of five words (op4 has four words and 0.85 by its contract).
    Rows that share a doc_id are one document and stay together; a null doc_id is a doc_id of its own.
    """
    core.tune(spark)
    kept = jaccard_classes(docs, n=5, num=4, den=5).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items.

    Null and empty texts hit nothing and stay, a null text as null; null ids and repeated rows are each judged on their own;
    an empty benchmark leaves all; an empty table stays empty; other columns go.
    """
    core.tune(spark)
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    packed = docs.select(F.struct("doc_id", F.col("text").isNull().alias("no_text"), *rest).alias("key"), "text")
    clean = benchmark_decontamination(packed, core.table(spark, sf_dir, "benchmark"), id_col="key").filter("not contaminated")
    text = F.when(~F.col("did.no_text"), F.col("body")).alias("text")
    return clean.select("did.doc_id", text, *[f"did.{c}" for c in rest]).select(*COLUMNS)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, confirmed secrets replaced in their texts and n_chars made to fit.

    Null and empty texts stay as they are; rows equal in id and text are masked alike, null ids too; an empty table stays
    empty; other columns go.
    """
    found = secret_scan(docs)
    masked = mask_secrets(docs.select(*COLUMNS), found)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix of the sources takes of each document, with the document, in the order of virtual finish times.

    A null or empty text has size 0 and gives 0 words; a null source is one of its own, the last; null ids come first in the
    shuffle; repeated rows are documents of their own; an empty table stays empty; other columns go.
    """
    core.tune(spark)
    out = mix_sources(docs, keep=("text", "lang", "n_chars"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "finish", "text", "lang", "n_chars").repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_masking),
    ("mixing sources to target weights", mixing),
]

#: Bag-of-n-grams models, a random forest and set joins: tested against brute force and held-out labels instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written to the shared folder and read as the next one's docs."""
    docs = core.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = core.checkpointed(docs)
    return docs
