"""A training-corpus pipeline: quality rules, near-duplicates, decontamination, personal data, segmentation.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all but the
last return the columns of `documents`. run() writes each stage as Parquet in the shared folder and reads it again; a
stage's input is deleted once its output is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import op1_piece_samples, op3_pii, op4_decontaminate, op6_simhash, op7_quality
from .common import park, table, tokenizer_path, unpark


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or lie far outside their language and source go."""
    return op7_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: linked by fingerprint or by a shingle Jaccard of 0.8."""
    return op6_simhash.deduplicate(docs, near_copies=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return op4_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return op3_pii.redact(docs, length_col="n_chars")


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text."""
    return op1_piece_samples.sample(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("segmentation", segmentation),
]

#: SQL can't express the robust estimates, the fingerprints and the sampling; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, park(stage(spark, docs, sf_dir), name)
        unpark(before)
    return STAGES[-1][1](spark, docs, sf_dir)
