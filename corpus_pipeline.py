"""The corpus pipeline: raw documents to token ids, in five stages.

Each stage takes what its predecessor kept and returns whole rows of ``documents``; the last returns
token ids. Every stage is written as Parquet to the shared folder and read again, so a lost executor
costs at most the stage it was in.

Defined cases: an empty table gives an empty result; rows with a null doc_id pass the near-duplicate and passage
stages whole and are judged and mixed like others; repeated rows that one stage keeps are kept as often as they
come; columns of any other name go along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, mixing, near_dedup, quality, suffix_dedup
from factloom.llm.common import scratch, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or lie far from their language and source, go."""
    return quality.keep_good(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 100 or more that occurred before are cut out of the texts, in whole characters."""
    return suffix_dedup.strip_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated until each source has its share of the words."""
    return mixing.mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a digest of what they decode to."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: Hash bands, transforms and merges have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table of documents; what they leave in the shared folder goes, but for the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), name)
        return keep(docs)
