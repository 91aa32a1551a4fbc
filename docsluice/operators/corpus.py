"""Corpus index: files → chunks → vectors → chunk table and manifest, resumable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsluice.functions import text as tx

# What counts as a text file, which folders are never entered, and the working limits.
TEXT_EXTENSIONS = (".txt", ".md", ".markdown", ".csv", ".log")
SKIP_DIRS = (".git", "node_modules")
EMBED_BATCH, EMBED_BATCH_MAX, SERVER_MAX_INPUTS = 48, 128, 256

CHUNK_SCHEMA = (
    "chunk_id string, text string, embedding array<double>, "
    "metadata struct<source_path:string,chunk_index:int,chunk_count:int>"
)


class IncompatibleResume(ValueError):
    """The index was begun with other parameters."""


class EmptyIndex(ValueError):
    """An index without a single chunk."""


def path_allowed(path: Column, skip_dirs: tuple[str, ...] = SKIP_DIRS) -> Column:
    """No segment of the path is a skipped folder."""
    return ~F.arrays_overlap(F.split(path, r"[/\\]"), F.array(*map(F.lit, skip_dirs)))


def is_text_file(path: Column, extensions: tuple[str, ...] = TEXT_EXTENSIONS) -> Column:
    return tx.extension(path).isin(*extensions)


def select_text_files(
    files: DataFrame,
    extensions: tuple[str, ...] = TEXT_EXTENSIONS,
    skip_dirs: tuple[str, ...] = SKIP_DIRS,
    max_bytes: int | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Keep the indexable files of a listing (path, length, …); only a caller's own limits leave any out."""
    kept = files.where(is_text_file(F.col("path"), extensions) & path_allowed(F.col("path"), skip_dirs))
    kept = kept if max_bytes is None else kept.where(F.col("length") <= max_bytes)
    return kept if max_files is None else kept.orderBy("path").limit(max_files)


def scan_counts(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """One row: files scanned, and files skipped for their size, among the text files of a listing."""
    text_files = files.where(is_text_file(F.col("path")) & path_allowed(F.col("path")))
    too_large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    return text_files.agg(F.count_if(~too_large).alias("files_scanned"), F.count_if(too_large).alias("files_skipped"))


def census(files: DataFrame) -> DataFrame:
    """Files per lower-case extension."""
    return files.groupBy(tx.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n_files"))


def extraction_route(path: Column) -> Column:
    """Which converter a file goes to: copy, docx, pdf, doc or other."""
    ext = tx.extension(path)
    return (
        F.when(ext.isin(".txt", ".md", ".markdown", ".csv", ".log"), "copy")
        .when(ext == ".docx", "docx")
        .when(ext == ".pdf", "pdf")
        .when(ext == ".doc", "doc")
        .otherwise("other")
    )


def extraction_report(outcomes: DataFrame) -> DataFrame:
    """Rows (path, outcome, error) → files per outcome; error texts stay rows of their own, see ``error_list``."""
    return outcomes.groupBy("outcome").agg(
        F.count("*").alias("n_files"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
        F.max(F.length("error")).alias("longest_error"),
    )


def error_list(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("error").isNotNull()).select("path", "outcome", "error")


def chunk_table(
    texts: DataFrame, path: str = "path", text: str = "text", max_chars: int | None = None, overlap: int | None = None
) -> DataFrame:
    """Rows (path, text) → one row per chunk with its ordinal, count and id ``path#i``."""
    pieces = texts.select(F.col(path).alias("source_path"), tx.chunk_pieces(F.col(text), max_chars, overlap).alias("p"))
    exploded = pieces.select("source_path", F.size("p").alias("chunk_count"), F.posexplode("p").alias("chunk_index", "text"))
    return exploded.select(
        F.concat_ws("#", "source_path", F.col("chunk_index").cast("string")).alias("chunk_id"),
        "text",
        F.struct("source_path", "chunk_index", "chunk_count").alias("metadata"),
    )


def resume_allowed(has_chunks: bool, has_manifest: bool, requested: bool | None = None) -> bool:
    """Resume only an index that has chunks and no manifest; a manifest forbids it even on request."""
    wanted = (has_chunks and not has_manifest) if requested is None else requested
    return wanted and not has_manifest


def check_build_state(state: dict | None, current: dict) -> None:
    """Refuse to resume when root, chunk size, overlap or model differ from the first run."""
    if not state:
        return
    differing = [k for k in ("root", "max_chars", "model") if state.get(k) is not None and state[k] != current.get(k)]
    if state.get("overlap") != current.get("overlap"):
        differing.append("overlap")
    if differing:
        raise IncompatibleResume("resume with other parameters: " + ", ".join(sorted(differing)))


def resume_filter(chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    """Chunks whose id is not in the index yet; sits below the embedding step so nothing is embedded twice."""
    return chunks.join(indexed.select("chunk_id"), "chunk_id", "left_anti")


def embed_batches(
    rows: DataFrame,
    fn: Callable[[list[str]], list[list[float]]],
    text: str = "text",
    out: str = "embedding",
    batch: int = EMBED_BATCH,
) -> DataFrame:
    """Add a vector column from a provider called with at most ``batch`` texts at a time.

    A reply with another number of vectors fails the task.
    """
    size = min(max(1, batch), EMBED_BATCH_MAX)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float]] = []
            for at in range(0, len(frame), size):
                texts = frame[text].iloc[at : at + size].tolist()
                reply = fn(texts)
                if len(reply) != len(texts):
                    raise ValueError(f"embedding provider returned {len(reply)} vectors for {len(texts)} texts")
                vectors.extend(reply)
            yield frame.assign(**{out: vectors})

    return rows.mapInPandas(run, schema)


def letter_class_embedder() -> Callable[[list[str]], list[list[float]]]:
    """A deterministic provider whose vectors SQL can state: counts of lower-case, upper-case, digit, blank and other letters."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for value in texts:
            lower, upper = sum("a" <= c <= "z" for c in value), sum("A" <= c <= "Z" for c in value)
            digits, blanks = sum("0" <= c <= "9" for c in value), value.count(" ")
            out.append([float(n) for n in (lower, upper, digits, blanks, len(value) - lower - upper - digits - blanks)])
        return out

    return run


def hashing_embedder(dims: int = 32) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic provider for tests: counts of hashed words, unit length."""

    def run(texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for value in texts:
            v = np.zeros(dims)
            for word in value.split():
                v[zlib.crc32(word.encode()) % dims] += 1.0
            length = float(np.linalg.norm(v))
            out.append((v / length if length else v).tolist())
        return out

    return run


def index_stats(chunks: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row: chunk count and the dimension of the first vector by id."""
    return chunks.agg(
        F.count("*").alias("chunk_count"), F.min_by(F.size(embedding), "chunk_id").alias("dimensions")
    )


def manifest(chunks: DataFrame, scan: DataFrame, settings: dict[str, str | int | None]) -> DataFrame:
    """The one-row index manifest; the scan's single row enters as scalars."""
    scanned = [scan.select(c).scalar().alias(c) for c in scan.columns]
    return index_stats(chunks).select("*", *scanned, *[F.lit(v).alias(k) for k, v in settings.items()])


def build_index(
    texts: DataFrame,
    embed: Callable[[list[str]], list[list[float]]],
    indexed: DataFrame | None = None,
    max_chars: int | None = None,
    overlap: int | None = None,
) -> DataFrame:
    """Texts → embedded chunk rows still missing from the index."""
    chunks = chunk_table(texts, max_chars=max_chars, overlap=overlap)
    if indexed is not None:
        chunks = resume_filter(chunks, indexed)
    rows = embed_batches(chunks, embed)
    return rows.select("chunk_id", "text", "embedding", "metadata")
