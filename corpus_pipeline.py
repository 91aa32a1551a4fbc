"""Documents to packed training sequences: stages that each take the rows their predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docsluice.llm import minhash, packing, quality, suffix_dedup
from docsluice.llm.queries import tokenizer_file
from docsluice.session import shared_folder


BATCH_ROWS = 1000  # rows of whole texts that tasks and their Python workers exchange at once


def _small_batches(spark: SparkSession) -> None:
    """Whole texts are long rows: the default of 10 000 of them in a batch is held by both sides of every task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network does not reject."""
    _small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    _small_batches(spark)
    return minhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that stand earlier."""
    _small_batches(spark)
    return suffix_dedup.remove_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in training sequences."""
    _small_batches(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), keep_tables=False)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packed),
]
ORACLE_SQL = None  # no stage can be stated in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the session's shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    out = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{n}")
        docs = spark.read.parquet(f"{out}/{n}")
    return docs
