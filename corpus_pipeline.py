"""A corpus pipeline: quality, near duplicates, personal data, mixing, token ids.

Each stage reads what the stage before it wrote. STAGES names them; run() applies them to the documents table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkhound.llm import mixing, pieces, pii, quality, similar
from sparkhound.llm.store import keep


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id (of repeated rows, the first).

    Documents are near duplicates if at least 0.8 of their runs of five words are common to both. SimHash links come first, an
    exact index finds the pairs whose fingerprints differ in more bits than those allow.
    """
    return similar.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data gives way to its kind in brackets."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: its blocks in the order of output shards and slots, a row for each document's part of a block."""
    return mixing.mixed_documents(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with token ids, their digests and the digest of the decoded text."""
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_text=False)


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("token ids", to_pieces),
]

#: SQL expresses neither the classifier's fit nor the exact merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
