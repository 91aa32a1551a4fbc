"""Whitening of vectors: exact integer cross-products from bit planes, then eigenvectors of the covariance.

An entry c becomes the integer x = floor(64 c) + 1000000.  A task takes blocks of rows, shifts every dimension by its
least value in the block, and packs each bit of the shifted values across rows into 64-bit words.  The cross-product of
two dimensions is the sum over pairs of their bit planes of 2**(a + b) times the number of rows where both bits are
set: the weighted population counts of the planes' conjunctions.  Undoing the shift, adding up tasks and centring
(n C - S S') are done on integers; only the centred result becomes floating-point, and its eigenvectors are refined in
extended precision.

What reaches the driver is the square of a vector's width, never rows.  Vectors of one width are one fit list; other
widths are lists of their own, each with its n, sums and components.

A row takes no part, and has no rows in the result, where its vector is null or empty, holds null or non-finite
entries, or an entry whose x does not fit in 62 bits.  Zero vectors, rows with a null vec_id and repeated rows count
as they come.  Components whose eigenvalue is not above ``LEAST`` of the largest (constant dimensions, fewer vectors
than dimensions) cannot be scaled to one and are left out; a single vector has none.  A deviation that does not fit in
a long is null.  An empty table gives an empty result.  Other columns play no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LEAST = 1e-10  # of the largest eigenvalue
BLOCK_ROWS = 4096
WORK_BYTES = 1 << 24  # of conjunctions held at once
LIMB = 30  # bits of a part of a large sum


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors).astype(np.int64) + SHIFT


def cross_products(y: np.ndarray) -> np.ndarray:
    """Exact y' y of non-negative integers, by bit planes."""
    rows, width = y.shape
    bits = int(y.max(initial=0)).bit_length()
    words = -(-rows // 64)
    planes = np.zeros((bits, width, words * 8), np.uint8)
    for a in range(bits):
        packed = np.packbits(((y >> a) & 1).astype(np.uint8), axis=0)
        planes[a, :, : len(packed)] = packed.T
    planes = planes.view(np.uint64)
    kind = np.int64 if 2 * bits + rows.bit_length() < 63 else object
    out = np.zeros((width, width), kind)
    step = max(1, WORK_BYTES // max(1, width * words * 8))
    for a in range(bits):
        for b in range(a, bits):
            both = np.concatenate([
                np.bitwise_count(planes[a, i : i + step, None, :] & planes[b, None, :, :]).sum(-1, dtype=np.int64) for i in range(0, width, step)
            ])
            both = both if a == b else both + both.T
            out += both.astype(kind) * (1 << (a + b))
    return out


class Sums:
    """n, S and C of integer vectors of one width, exactly."""

    def __init__(self, width: int):
        self.n, self.s, self.c = 0, np.zeros(width, object), np.zeros((width, width), object)

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), BLOCK_ROWS):
            block = x[at : at + BLOCK_ROWS]
            low = block.min(axis=0)
            y = block - low
            m, s = low.astype(object), y.astype(object).sum(axis=0) if int(y.max()) >> 50 else y.sum(axis=0).astype(object)
            self.n += len(block)
            self.s += s + len(block) * m
            self.c += cross_products(y).astype(object) + np.outer(m, s) + np.outer(s, m) + len(block) * np.outer(m, m)

    def cells(self) -> Iterator[tuple[int, int, int]]:
        """(i, j, value); S is row -1, n stands at (-1, -1)."""
        yield -1, -1, self.n
        for i, v in enumerate(self.s):
            yield -1, i, int(v)
            for j in range(i, len(self.s)):
                yield i, j, int(self.c[i, j])


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """Parts of an integer that tasks may add up as longs; the last carries the sign."""
    at = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        yield at, value & ((1 << LIMB) - 1)
        value >>= LIMB
        at += 1
    yield at, value


class Whitener(NamedTuple):
    n: int
    sums: list[int]
    axes: np.ndarray  # one column for each component, divided by the root of its eigenvalue
    explained: np.ndarray


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their unit eigenvectors: LAPACK's, improved in extended precision."""
    _, x = np.linalg.eigh(v.astype(np.float64))
    x = x[:, ::-1].astype(np.longdouble)
    for _ in range(2):
        gap = np.eye(len(v), dtype=np.longdouble) - x.T @ x
        s = x.T @ v @ x
        s, gap = (s + s.T) / 2, (gap + gap.T) / 2
        e = np.diag(s) / (1 - np.diag(gap))
        slack = 2 * (np.abs(s - np.diag(e)).max() + np.abs(e).max() * np.abs(gap).max()) * len(v)
        apart = e[None, :] - e[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(np.abs(apart) > slack, (s + e[None, :] * gap) / apart, gap / 2)
        np.fill_diagonal(step, np.diag(gap) / 2)
        x = x + x @ step
    e = np.einsum("ij,ij->j", x, v @ x) / (x * x).sum(axis=0)
    order = np.argsort(-e, kind="stable")
    return e[order], (x / np.sqrt((x * x).sum(axis=0)))[:, order]


def whitener(n: int, s: list[int], c: dict[tuple[int, int], int], components: int = COMPONENTS) -> Whitener:
    width = len(s)
    v = np.zeros((width, width), np.longdouble)
    for (i, j), value in c.items():
        whole, rest = divmod(n * value - s[i] * s[j], n * n)
        v[i, j] = v[j, i] = np.longdouble(whole) + np.longdouble(rest / (n * n))
    e, x = eigen(v)
    kept = min(components, int((e > LEAST * max(e[0], 0)).sum())) if e[0] > 0 else 0
    return Whitener(n, s, (x[:, :kept] / np.sqrt(e[:kept])).astype(np.float64), (e[:kept] / np.trace(v)).astype(np.float64))


def _usable(rows: DataFrame, column: str) -> DataFrame:
    top = float(2**61 // SCALE)
    fits = F.forall(F.col(column), lambda c: c.isNotNull() & (F.abs(c) < top))  # NaN is above all numbers
    return rows.where((F.size(column) > 0) & F.coalesce(fits, F.lit(False)))


def _by_width(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the rows of each width."""
    lists = batch.column(column)
    widths = lists.value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        flat = (lists if len(at) == len(widths) else lists.take(pa.array(at))).flatten()
        yield at, flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


_CELLS = pa.schema([("width", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> dict[int, Whitener]:
    """The whitener of each width, from all usable rows in one pass."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, Sums] = {}
        for batch in batches:
            for _, m in _by_width(batch, 0):
                totals.setdefault(m.shape[1], Sums(m.shape[1])).add(integers(m))
        for width, total in totals.items():
            cells = [(width, i, j, k, part) for i, j, value in total.cells() for k, part in limbs(value)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*cells), _CELLS)], schema=_CELLS)

    partial = _usable(rows, column).select(column).mapInArrow(work, "width int, i int, j int, limb int, value long")
    sums: dict[int, dict[tuple[int, int], int]] = defaultdict(lambda: defaultdict(int))
    # The square of a width at most, for each width.
    for r in partial.groupBy("width", "i", "j", "limb").agg(F.sum("value").alias("value")).collect():
        sums[r["width"]][r["i"], r["j"]] += r["value"] << (LIMB * r["limb"])
    out = {}
    for width, cells in sums.items():
        n, s = cells.pop((-1, -1)), [cells.pop((-1, i)) for i in range(width)]
        out[width] = whitener(n, s, cells, components)
    return out


def transform(w: Whitener, vectors: np.ndarray) -> tuple[list[int | None], np.ndarray]:
    """Deviation and whitened components of each row."""
    x = integers(vectors)
    high = max(abs(int(x.max())), abs(int(x.min())), max(map(abs, w.sums)) // w.n + 1)
    if 2 * high * w.n < 1 << 62:
        t = w.n * x - np.array(w.sums, np.int64)
    else:
        t = x.astype(object) * w.n - np.array(w.sums, object)
    top = int(np.abs(t).max())
    square = t if t.dtype == object or top * top * t.shape[1] < 1 << 63 else t.astype(object)
    deviation = [int(d) if d < 1 << 63 else None for d in (square * square).sum(axis=1).tolist()]
    return deviation, (t / w.n).astype(np.float64) @ w.axes


def identity_error(rows: DataFrame, column: str, fitted: dict[int, Whitener]) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, over all rows."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, m in _by_width(batch, 0):
                _, z = transform(fitted[m.shape[1]], m)
                z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
                sums[m.shape[1]] = sums.get(m.shape[1], 0) + z.T @ z
        for width, q in sums.items():
            i, j = np.indices(q.shape).reshape(2, -1)
            yield pa.RecordBatch.from_pydict({"width": np.full(q.size, width, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "value": q.ravel()})

    partial = _usable(rows, column).select(column).mapInArrow(work, "width int, i int, j int, value double")
    worst, total = 0.0, {}
    for r in partial.groupBy("width", "i", "j").agg(F.sum("value").alias("value")).collect():
        total[r["width"], r["i"], r["j"]] = r["value"]
    for width, w in fitted.items():
        k = w.axes.shape[1]
        q = np.array([[total.get((width, i, j), 0.0) for j in range(k + 1)] for i in range(k + 1)])
        cov = q[:k, :k] / w.n - np.outer(q[:k, k], q[:k, k]) / w.n**2
        worst = max(worst, float(np.abs(cov - np.eye(k)).max(initial=0.0)))
    return worst


def whiten(rows: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    fitted = fit(rows, column, components)
    worst = identity_error(rows, column, fitted)
    names = ["component", "n", "deviation", "whitened", "explained"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in _by_width(batch, 1):
                w = fitted[m.shape[1]]
                k = w.axes.shape[1]
                if not k:
                    continue
                deviation, z = transform(w, m)
                ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                values = [np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)), np.full(k * len(at), w.n), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                          z.ravel(), np.tile(w.explained, len(at))]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) if isinstance(v, np.ndarray) else v for v, t in zip(values, types))], names=[key, *names])

    out = _usable(rows, column).select(F.col(key).cast("long").alias(key), column).mapInArrow(work, f"`{key}` long, component int, n long, deviation long, whitened double, explained double")
    return out.withColumn("identity_error", F.lit(worst))
