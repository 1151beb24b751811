"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    op1_piece_samples,
    op2_licenses,
    op3_pii,
    op4_decontaminate,
    op5_token_files,
    op6_simhash,
    op7_quality,
    op8_quality_classifier,
    op9_language,
    op10_toxicity,
    op11_prefix_trie,
    op12_hard_negatives,
    op13_line_dedup,
    pipeline,
)
from .common import table, tokenizer_path


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op1_piece_samples.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    n_pieces = F.size("ids").cast("long").alias("n_pieces")
    return found.select("doc_id", "rank", n_pieces, "ids_crc32", "decoded", "log_prob", "perturbed", "inclusion", "ids")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_licenses.scan(table(spark, sf_dir, "documents"))


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_pii.detect(table(spark, sf_dir, "documents"))


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(op5_token_files.TOKENIZER))


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op6_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_quality.verdicts(table(spark, sf_dir, "documents"))


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quality_classifier.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_language.predict(table(spark, sf_dir, "documents"))


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_line_dedup.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": pipeline.run,
    "op1_piece_samples": op1_query,
    "op2_licenses": op2_query,
    "op3_pii": op3_query,
    "op4_decontaminate": op4_query,
    "op5_token_files": op5_query,
    "op6_simhash": op6_query,
    "op7_quality": op7_query,
    "op8_quality_classifier": op8_query,
    "op9_language": op9_query,
    "op10_toxicity": op10_query,
    "op11_prefix_trie": op11_query,
    "op12_hard_negatives": op12_query,
    "op13_line_dedup": op13_query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_licenses": op2_licenses.oracle_sql(),
    "op3_pii": op3_pii.oracle_sql(),
    "op11_prefix_trie": op11_prefix_trie.oracle_sql(),
    "op12_hard_negatives": op12_hard_negatives.oracle_sql(),
    "op13_line_dedup": op13_line_dedup.oracle_sql(),
}
