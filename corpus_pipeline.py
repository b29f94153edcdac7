"""A corpus cleaned, mixed and tokenised: five stages, each of them one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradelanes.llm import bpe, exact_dedup, mixing, simhash, toxicity_svm
from tradelanes.llm.common import table
from tradelanes.session import materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, by a machine fitted on the labelled ones among ``docs``."""
    return toxicity_svm.score_toxicity(docs, toxicity_svm.fit(docs, table(spark, sf_dir, "labels")), keep=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints link."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and their digests."""
    return bpe.encode_documents(docs, keep_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: SQL can express neither a trained classifier nor the fingerprints; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
