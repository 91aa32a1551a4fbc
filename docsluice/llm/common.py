"""Helpers the training-data jobs share: texts as bytes inside tasks, 64-bit mixing, lineage cuts, linked groups."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 18  # texts are worked on in pieces of about this many bytes, so memory does not follow the batch
SLICE_BYTES = 1 << 21  # and rows of a batch in slices of about this many


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder that the session names in ``spark.checkpoint.dir``."""
    from docsluice.session import cut_lineage

    return cut_lineage(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a compressed table in the session's shared folder, read again by column."""
    from docsluice.session import shared_folder

    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) and nothing else, so columns of other names cannot clash; a null text is empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def utf8_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets, without a copy."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    bounds = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, bounds


def groups_of_rows(bounds: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a few megabytes of text each; what Arrow keeps after one goes back to the system."""
    _, bounds = utf8_rows(batch.column(column))
    for a, b in groups_of_rows(bounds, limit):
        yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()


def give_back() -> None:
    """What Arrow and the C library keep of freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # a C library without it decides for itself
    if trim is not None:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function whose worker keeps nothing behind a task: Spark lets idle workers live on beside later stages."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            _powers.clear()
            give_back()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_ROOT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_LETTERS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the root and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_ROOT), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 20), r, np.uint64)]).cumprod(dtype=np.uint64) for r in (_ROOT, inverse)]
    return _powers[0], _powers[1]


class Bytes:
    """Hashes of ranges of a byte array."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _tables(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_LETTERS[raw] * up[: len(raw)], out=self.sums[1:], dtype=np.uint64)

    def hash(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Scrambled identifiers of [first, last)."""
        return mix64((self.sums[last] - self.sums[first]) * self.down[first])

    def grams(self, q: int) -> np.ndarray:
        n = len(self.sums) - q
        return mix64((self.sums[q:] - self.sums[:n]) * self.down[:n])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the ends of (a, b) edges; component is the smallest node that can be reached.

    Alternating large-star and small-star rounds: every round is a minimum per node (combined before the shuffle) and
    one join, so neither a hub nor a large group meets in one task, and the rounds grow with the logarithm of the
    longest path.  Ends when a round changes nothing.
    """
    from docsluice.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(edges.sparkSession)
    e = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        # Large star: link every larger neighbour of a node to the smallest in its neighbourhood.
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: link every smaller neighbour, and the node, to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        e = checkpoint(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).cast("string")).first()
        if before == tuple(now):
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = tuple(now)
    raise RuntimeError("linked groups did not settle")


DISK = StorageLevel.DISK_ONLY
