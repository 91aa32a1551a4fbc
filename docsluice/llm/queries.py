"""The registered queries of the training-data jobs, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.llm import alignment, ann, bpe, chat, license_scan, minhash, packing, quality, suffix_dedup, token_counts, url_filter, vector_dedup, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed collection of public tokenizers; every executor has the collection."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


@_query("op1_posting_lists")
def _posting_lists(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@_query("op2_trie_token_counts")
def _trie_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


@_query("op3_bottom_k_dedup")
def _bottom_k_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"), width=2)


@_query("op4_suffix_dedup")
def _suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digest(_table(spark, folder, "documents"))


@_query("op5_quality_network")
def _quality_network(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query("op6_url_filter", url_filter.SQL)
def _url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, folder, "pages"))


@_query("op7_bpe_codec")
def _bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digest_documents(_table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


@_query("op8_multi_index_dedup")
def _multi_index_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, folder, "embeddings"))


@_query("op9_pattern_packing")
def _pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


@_query("op10_fuzzy_licenses")
def _fuzzy_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_documents(_table(spark, folder, "documents"))


@_query("op11_budgeted_chat")
def _budgeted_chat(spark: SparkSession, folder: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"  # control strings as text: a conversation that must come back whole
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id = 0, 'user', 'assistant')").alias("role"), F.lit(tricky).alias("text"))
    return chat.digest(chat.windows(rows.unionByName(more), tokenizer_file("byte_bpe_50k.json")))


@_query("op12_bit_sliced_whitening")
def _bit_sliced_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


@_query("op13_pointer_alignment")
def _pointer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.digest(_table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
