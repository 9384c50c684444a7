"""Corpus pipeline: recognised language, near-duplicates removed, sources mixed, text encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import bpe, langid, minhash, mixing
from spanloom.session import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return langid.keep_recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.apply_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digests of ids and decoded text."""
    return bpe.encode_corpus(docs, *bpe.tokenizer())


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("source_mixing", mixture),
    ("bpe_encoding", encoding),
]

#: Sampling, learned machines and merge replay are beyond SQL; the tests replay the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
