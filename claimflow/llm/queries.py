"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimflow.llm.common import read
from claimflow.llm.decontamination import DECONTAMINATION_SQL, overlaps
from claimflow.llm.hard_negatives import HARD_NEGATIVES_SQL, hard_negative_digest
from claimflow.llm.html_text import extract_pages
from claimflow.llm.jaccard_join import jaccard_digest
from claimflow.llm.line_dedup import LINE_DEDUP_SQL, line_dedup_digest
from claimflow.llm.piece_codec import piece_digest
from claimflow.llm.quality_rules import QUALITY_SQL, quality_verdicts
from claimflow.llm.secret_scan import secret_digest
from claimflow.llm.simhash import simhash_digest
from claimflow.llm.suffix_dedup import suffix_digest
from claimflow.llm.token_counts import corpus_token_totals
from claimflow.llm.token_shards import token_shard_digest
from claimflow.llm.vector_codes import VECTOR_CODES_SQL, vector_code_digest


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digest(read(spark, sf_dir, "documents"))


def op3_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shard_digest(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(read(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digest(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_token_totals(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), {
        "byte_bpe_50k": ("bytes", public_tokenizers.path("byte_bpe_50k.json")),
        "piece_bpe_32k": ("pieces", public_tokenizers.path("piece_bpe_32k.model")),
    })


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_digest(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negative_digest(read(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_code_digest(read(spark, sf_dir, "embeddings"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_digest(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_token_id_output": op3_token_id_output,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_extraction": op5_html_extraction,
    "op6_secret_scan": op6_secret_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_vector_codes": op12_vector_codes,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}

ORACLE = {
    "op1_benchmark_decontamination": DECONTAMINATION_SQL,
    "op4_quality_rules": QUALITY_SQL,
    "op8_line_dedup": LINE_DEDUP_SQL,
    "op11_hard_negatives": HARD_NEGATIVES_SQL,
    "op12_vector_codes": VECTOR_CODES_SQL,
}
