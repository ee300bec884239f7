"""A corpus pipeline: quality rules, near-dedup, suffix-array dedup, mixing, tokens.

Each stage takes the documents that its predecessor kept and is written as Parquet before the next one reads them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newslake.llm import bpe, mixing, neardup, quality, suffixdedup
from newslake.llm.common import table
from newslake.session import checkpoint_dir

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: No SQL: MinHash links, removal of repeated bytes, the schedule and BPE are beyond it. Tests hold each stage against a
#: brute-force version.
ORACLE_SQL: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their cleaned text."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 or more of five-word shingles), the one with the smallest id."""
    return neardup.keep(docs, neardup.STAGE_PERCENT)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without byte strings that occur elsewhere."""
    return suffixdedup.stripped(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a copy of a document for each time it is taken."""
    return mixing.mixed_texts(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens per document of the mix: doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    return bpe.report(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
