"""The corpus pipeline: filters, near-duplicates, decontamination, secrets and packing of ``documents``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vidmetrics.llm import packing, resemblance, secrets, templates, toxicity
from vidmetrics.llm.common import saved, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine scores 0.3 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8 of 5-word shingles) stays, the one of the smallest id: the SimHash
    trie links fingerprints, bands find copies of more differing bits, and all links are checked on the shingles."""
    return resemblance.one_of_each_group(docs, shingle_words=5, least=0.8, errors=3)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the same values or others and in any case, go."""
    return templates.without_leaks(docs, table(spark, sf_dir, "benchmark"), any_case=True, by_window=True)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by the kind of secret; all documents stay."""
    return secrets.mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean_of_toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: No SQL: a trained kernel machine and a tokenizer decide. The tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
