"""Corpus pipeline: five cleaning and tokenizing stages over ``documents``.

``STAGES`` names them in order; ``run`` applies them, writing each stage's
rows as Parquet in the shared folder and rereading them as the next stage's
documents, so a lost executor never costs more than the running stage.

Defined cases: a null or empty text has no words and goes in the first stage;
rows that repeat an id are one document, which stays or goes with all its
rows; rows with a null id are together one document for the line and
near-duplicate stages, and go if a document with an id is their near
duplicate; no documents give no rows. Columns beyond those of ``documents``
pass through whatever their names, but for ``token_ids``, ``n_tokens`` and
``decoded_sha256``, which the last stage sets; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimflow.llm.common import free_name, materialise, read
from claimflow.llm.decontamination import decontaminate
from claimflow.llm.line_dedup import line_dedup
from claimflow.llm.piece_codec import piece_decode, piece_encode
from claimflow.llm.quality_rules import quality_filter
from claimflow.llm.simhash import simhash_dedup

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share go, but for the last holder's; n_chars follows."""
    counts = free_name(docs, "__line_dedup")
    kept = line_dedup(docs, out_col=counts).drop(counts)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component stays."""
    return simhash_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their sentencepiece ids (end id included), their number and the SHA-256 of the text the ids decode to."""
    rows = piece_encode(docs, PIECES).withColumn("n_tokens", F.size("token_ids").cast("long"))
    text = free_name(rows, "__decoded")
    return piece_decode(rows, PIECES, out_col=text).withColumn("decoded_sha256", F.sha2(text, 256)).drop(text)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece encoding and decoding", tokenize_stage),
]

# Fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{k}-{name.replace(' ', '-')}")
    return docs
