"""A corpus pipeline: language ID, near-duplicate removal, masking of personal
data, packing.  Each stage is written as Parquet and reread as the next one's
documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gutterline.llm import common, language_id, near_copies, packing, pii
from gutterline.llm.queries import vocabulary


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that no learned language accounts for go."""
    return language_id.without_rejected(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by 5-word shingles of Jaccard
    similarity 0.8 or more, the smallest id stays."""
    return near_copies.first_of_each(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: personal data are replaced by their kind."""
    return pii.mask_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: pieces of all documents in sequences of 1024 tokens."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"), end_id=0)


STAGES = [("language_id", identify), ("near_dedup", deduplicate), ("pii", mask), ("packing", pack)]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
