"""The corpus operators as registered queries: each reads its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact, hmm, importance, lines, packing, pjpeg, rindex, secrets, simhash
from .common import table


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pjpeg.digests(pjpeg.media(table(spark, sf_dir, "documents")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rindex.remove_repeats(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact.exact_dedup(docs, exact.older_half(docs))


def op9_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.members(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_importance_resampling, op2_hmm_scoring, op3_simhash_near_dedup, op4_progressive_jpeg, op5_best_fit_packing, op6_run_length_index, op7_secret_scan, op8_exact_dedup, op9_line_edit_join, op10_byte_bpe)}

OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ORACLE_SQL = {"op8_exact_dedup": OP8_SQL}
