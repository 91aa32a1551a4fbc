"""What the two vector operators share: usable vectors, codebooks from bounded samples, blocks met by streams."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, every component a finite number, and not all zero; never null itself."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def sample(rows: DataFrame, column: str, key: str, size: int) -> np.ndarray:
    """A bounded sample: the vectors with the smallest hashes of their ids.

    A table's ordered limit takes that many rows of every partition to the driver.  So only rows below a bound are
    ordered that about ``size`` hashes keep, with a margin; all rows are where fewer are found, as with repeated ids.
    """
    hashed = F.xxhash64(F.col(key))
    wanted = size + 10 * math.isqrt(size) + 100
    total = rows.count()
    if total > wanted:
        some = rows.where(hashed < F.lit(-(1 << 63) + (1 << 64) * wanted // total))
        rows = some if some.count() >= size else rows
    return matrix(rows.orderBy(hashed, key).limit(size).select(column).toArrow().combine_chunks().column(0).combine_chunks())


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of at most k clusters of distinct points."""
    points = np.unique(x, axis=0)
    if len(points) <= k:
        return points
    rng = np.random.default_rng(seed)
    c = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        home = distances(x, c).argmin(1)
        size = np.bincount(home, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        c = np.where(size[:, None] > 0, total / np.maximum(1, size)[:, None], c)
    return c


def blocks_and_streams(schema_key: int, work: Callable[[tuple, list[pa.RecordBatch], Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A mapInArrow function over rows sorted by a key of ``schema_key`` columns and then a flag column.

    Rows with flag 0 are a key's block and are held together (callers bound their number); rows with flag 1 pass by in
    batches of any number.  ``work(key, block, stream)`` must read its stream to the end.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = np.zeros(n, bool)
            change[0] = True
            for i in range(schema_key + 1):
                v = batch.column(i).to_numpy(zero_copy_only=False)
                change[1:] |= v[1:] != v[:-1]
            edges = [*np.flatnonzero(change).tolist(), n]
            for a, b in zip(edges[:-1], edges[1:]):
                key = tuple(batch.column(i)[a].as_py() for i in range(schema_key + 1))
                yield key[:-1], key[-1], batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = split(batches)
        ahead = next(parts, None)
        while ahead is not None:
            key, block = ahead[0], []
            while ahead is not None and ahead[0] == key and ahead[1] == 0:
                block.append(ahead[2])
                ahead = next(parts, None)

            def stream() -> Iterator[pa.RecordBatch]:
                nonlocal ahead
                while ahead is not None and ahead[0] == key:
                    yield ahead[2]
                    ahead = next(parts, None)

            passing = stream()
            yield from work(key, block, passing)
            for _ in passing:
                pass

    return run
