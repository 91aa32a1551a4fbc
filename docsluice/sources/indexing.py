"""The index job from a folder of files to a chunk index with its manifest, resumable where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from docsluice.operators import corpus
from docsluice.sources import readers, sinks

_STATE = "root string, max_chars int, overlap int, model string"


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """JSON rows of a folder, or None if there is no such folder."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def build(
    spark: SparkSession,
    root: str,
    index: str,
    embed: Callable[[list[str]], list[list[float]]],
    model: str,
    max_chars: int | None = None,
    overlap: int | None = None,
    resume: bool | None = None,
) -> dict:
    """Scan ``root``, write missing chunks with their vectors to ``index/chunks`` and the manifest to ``index/manifest``.

    An index without a manifest is resumed: chunks it has are not embedded again, and other parameters than those it was
    begun with are refused.  The manifest is made from what was written, so each chunk is embedded once, and only an
    index with chunks gets one.
    """
    chunks, state, manifest = f"{index}/chunks", f"{index}/state", f"{index}/manifest"
    begun, done = _rows(spark, chunks, corpus.CHUNK_SCHEMA), _rows(spark, manifest, "chunk_count bigint")
    going_on = corpus.resume_allowed(begun is not None and not begun.isEmpty(), done is not None and not done.isEmpty(), resume)
    current = {"root": root, "max_chars": max_chars, "overlap": overlap, "model": model}
    if going_on:
        before = _rows(spark, state, _STATE)
        row = before.first() if before is not None else None  # one row by construction
        corpus.check_build_state(row.asDict() if row else None, current)
    spark.createDataFrame([tuple(current.values())], _STATE).write.mode("overwrite").json(state)
    texts = readers.scan_text_corpus(spark, root).select("path", "text")
    built = corpus.build_index(texts, embed, begun.where("chunk_id is not null") if going_on else None, max_chars, overlap)
    sinks.write_chunk_index(built, chunks, resume=going_on)
    written = spark.read.schema(corpus.CHUNK_SCHEMA).option("mode", "DROPMALFORMED").json(chunks).where("chunk_id is not null")
    counts = corpus.scan_counts(readers.list_files(spark, root))
    return sinks.write_index_manifest(corpus.manifest(written, counts, {"model": model, "max_chars": max_chars, "overlap_chars": overlap}), manifest)
