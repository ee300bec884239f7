"""The registered queries of this package and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newslake.llm import bpe, chat, hardneg, langid, licenses, mixing, neardup, quality, suffixdedup, syncmers, topk, trie, urlfilter
from newslake.llm.common import table

#: Rank file of the tokenizer, among the public vocabularies.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing_sources(spark: SparkSession, path: str) -> DataFrame:
    return mixing.report(table(spark, path, "documents", ["doc_id", "text", "source"]))


def op2_url_filters(spark: SparkSession, path: str) -> DataFrame:
    return urlfilter.judge(table(spark, path, "pages", ["page_id", "url", "html"])).drop("component")


def op3_minhash_near_dedup(spark: SparkSession, path: str) -> DataFrame:
    return neardup.report(table(spark, path, "documents", ["doc_id", "text"]))


def op4_license_scans(spark: SparkSession, path: str) -> DataFrame:
    return licenses.scan(table(spark, path, "documents", ["doc_id", "text"]))


def op5_quality_rules(spark: SparkSession, path: str) -> DataFrame:
    return quality.report(table(spark, path, "documents", ["doc_id", "text"]))


def op6_suffix_array_dedup(spark: SparkSession, path: str) -> DataFrame:
    return suffixdedup.report(table(spark, path, "documents", ["doc_id", "text"]))


def op7_chat_formatting(spark: SparkSession, path: str) -> DataFrame:
    return chat.report(chat.with_control_strings(spark, table(spark, path, "conversations")))


def op8_byte_level_bpe(spark: SparkSession, path: str) -> DataFrame:
    return bpe.report(table(spark, path, "documents", ["doc_id", "text"]), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op9_language_id(spark: SparkSession, path: str) -> DataFrame:
    return langid.report(table(spark, path, "documents", ["doc_id", "text", "lang"]))


def op10_exact_topk(spark: SparkSession, path: str) -> DataFrame:
    return topk.report(table(spark, path, "embeddings", ["vec_id", "embedding"]))


def op11_conversation_trie(spark: SparkSession, path: str) -> DataFrame:
    return trie.trie(table(spark, path, "conversations"))


def op12_document_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return syncmers.report(table(spark, path, "documents", ["doc_id", "text"]))


def op13_hard_negatives(spark: SparkSession, path: str) -> DataFrame:
    return hardneg.mine(table(spark, path, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_mixing_sources, op2_url_filters, op3_minhash_near_dedup, op4_license_scans, op5_quality_rules, op6_suffix_array_dedup, op7_chat_formatting,
    op8_byte_level_bpe, op9_language_id, op10_exact_topk, op11_conversation_trie, op12_document_fingerprints, op13_hard_negatives,
)}
SQL: dict[str, str] = {
    "op2_url_filters": urlfilter.sql(), "op5_quality_rules": quality.sql(), "op7_chat_formatting": chat.sql(),
    "op10_exact_topk": topk.sql(), "op11_conversation_trie": trie.sql(), "op13_hard_negatives": hardneg.sql(),
}
