"""The corpus pipeline: quality, exact dedup, near-dedup, decontamination, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a frame; ``run`` writes it as a
Parquet table in the shared folder and reads it again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``; the last one returns doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left.

A row with a null doc_id passes the dedup and decontamination stages; rows that repeat a doc_id stay or go together there,
whatever their texts. A null text is scored, and encoded, as an empty one. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import stored, table, without_ids, work_folder
from gridloom.llm.decontaminate import decontaminated
from gridloom.llm.exact_dedup import exact_dedup
from gridloom.llm.near_dedup import near_dedup
from gridloom.llm.pieces import round_trip
from gridloom.llm.quality import fit, selected


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, expects to be good."""
    return selected(docs, fit(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest doc_id."""
    return without_ids(docs, exact_dedup(docs).where("not kept"), work_folder(spark, "pipeline"), "copies")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents, the one with the smallest doc_id. Documents link at five-word shingles and 0.8."""
    return without_ids(docs, near_dedup(docs, size=5, percent=80).where("not kept"), work_folder(spark, "pipeline"), "near")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = decontaminated(docs, table(spark, sf_dir, "benchmark"))
    return without_ids(docs, found.where("contaminated"), work_folder(spark, "pipeline"), "leaks")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text they decode to, as digests."""
    return round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

#: The classifier and the token ids can't be expressed in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "stages")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), folder, str(k))
    return docs
