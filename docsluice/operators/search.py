"""Exact top-k cosine search of a batch of queries over a chunk table.

Pairs of rows are never shuffled.  A batch whose size is checked to be small travels to the chunk scan, where each task
scores Arrow batches as one matrix product and keeps k rows per query.  A larger batch is matched cell by cell: both
sides are assigned to the nearest of the pivots, whose number grows with the root of the rows; queries of neighbouring
cells form slices of bounded size; a first pass over a block of their cells' rows bounds how far a hit can be, and the
triangle inequality then leaves few cells, and rings of them, for the second.  Where vectors lie so that it leaves all,
a row is shipped once for each slice, and there are as few of these as their size allows.  Both ways are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsluice.functions.patterns import WS
from docsluice.session import cut_lineage

# Default and largest hit counts of search, question and chat.
TOP_K_SEARCH, TOP_K_ASK, TOP_K_CHAT, TOP_K_CHAT_MAX = 12, 10, 8, 24

MAX_SHIPPED_FLOATS = 4_000_000  # a query batch up to this size (32 MB) travels to the chunk scan
SCORE_DIGITS = 9  # scores are compared after rounding, so ties fall to the id and not to summation order
SLICE_FLOATS = 2_000_000  # queries in a slice (8 MB of 32-bit numbers): every row that they reach is shipped once for them
PART_FLOATS = 4_000_000  # rows in a part of what a slice reaches: its queries are shipped once for each part
SHORT_PART_ROWS = 8192  # parts may be shorter where there are fewer tasks than cores, but not than this
MAX_BROADCAST_ROWS = 1_000_000  # rows (48 MB) of the table that says which slice needs which cell
TILE_SCORES = 500_000  # scores computed at once (2 MB of 32-bit numbers), whatever the number of queries and rows
MAX_PIVOTS = 4096
NEAR_CELLS = 16  # cells around a query that give its first bound
REACH_ROWS = 256  # queries whose first bounds are computed at once
SLACK = 1e-4  # margin of the distance bounds: covers scores that are equal only after rounding


def _matrix(column: pd.Series | list) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column])


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _tiles(n_queries: int, n_rows: int) -> Iterator[tuple[slice, slice]]:
    """Query and row ranges whose scores fit TILE_SCORES."""
    wide = min(n_rows, max(4096, TILE_SCORES // max(1, n_queries)))
    tall = max(1, TILE_SCORES // max(1, wide))
    for r in range(0, n_rows, max(1, wide)):
        for q in range(0, n_queries, tall):
            yield slice(q, min(n_queries, q + tall)), slice(r, min(n_rows, r + wide))


class _Nearest:
    """The k best (score, id) of every query over rows that come in parts; ties go to the smaller id.

    What may be a hit waits until there is as much of it as of hits, and is then merged with them at once.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.q32 = queries.astype(np.float32)
        self.floor = np.full(len(queries), -np.inf)  # the k-th best score is this at least
        self.last = np.full(len(queries), -1)  # where in ``ids`` the k-th best is, if the floor is its score
        self.row, self.score = np.zeros(0, np.int64), np.zeros(0)
        self.ids: np.ndarray | None = None
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, unit_rows: np.ndarray, ids: np.ndarray) -> None:
        rows32 = unit_rows.astype(np.float32)
        margin = 10**-SCORE_DIGITS + (unit_rows.shape[1] + 4) * 2.0 * np.finfo(np.float32).eps  # more than rounding can add
        for qs, rs in _tiles(len(self.q), len(ids)):
            scores = self.q32[qs] @ rows32[rs].T  # tells what may be a hit; that is then scored in double precision
            near = None if np.isneginf(self.floor[qs]).any() else scores >= (self.floor[qs] - margin).astype(np.float32)[:, None]
            if scores.shape[1] > self.k and (near is None or np.count_nonzero(near) > self.k * len(scores)):
                at = scores.shape[1] - self.k
                least = np.partition(scores, at, axis=1)[:, at] - margin
                higher = least > self.floor[qs]
                self.floor[qs] = np.where(higher, least, self.floor[qs])
                self.last[qs] = np.where(higher, -1, self.last[qs])
                near = None
            if near is None:
                near = scores >= (self.floor[qs] - margin).astype(np.float32)[:, None]
            row, col = np.divmod(np.flatnonzero(near), scores.shape[1])
            exact = [
                np.einsum("ij,ij->i", self.q[qs][row[i : i + 65_536]], unit_rows[rs][col[i : i + 65_536]]) for i in range(0, len(row), 65_536)
            ]
            score = np.round(np.concatenate([np.zeros(0), *exact]), SCORE_DIGITS) + 0.0
            row, found = row + qs.start, ids[rs][col]
            level = score == self.floor[row]
            level[level] = self._before(row[level], found[level])
            kept = level | (score > self.floor[row])
            if kept.any():
                self.waiting.append((row[kept], score[kept], found[kept]))
                self.n_waiting += len(self.waiting[-1][0])
                if self.n_waiting > max(1_000_000, len(self.q) * self.k):
                    self._merge()

    def _before(self, row: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether rows of the k-th best score come before the k-th best, or may do so."""
        at, out = self.last[row], np.ones(len(row), bool)
        if ids.dtype != object and (at >= 0).any():
            out[at >= 0] = ~(ids[at >= 0] >= self.ids[at[at >= 0]])
        return out

    def _merge(self) -> None:
        if not self.waiting:
            return
        held = [(self.row, self.score, self.ids)] if self.ids is not None else []
        row, score, ids = (np.concatenate(x) for x in zip(*held, *self.waiting))
        self.waiting, self.n_waiting = [], 0
        order = np.lexsort((ids if ids.dtype.kind == "i" else pd.factorize(ids, sort=True)[0], -score, row))
        row, score, ids = row[order], score[order], ids[order]
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        rank = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
        kept = rank < self.k
        self.row, self.score, self.ids, rank = row[kept], score[kept], ids[kept], rank[kept]
        full = np.flatnonzero(rank == self.k - 1)
        self.floor[self.row[full]], self.last[:] = self.score[full], -1
        self.last[self.row[full]] = full

    def floors(self) -> np.ndarray:
        """The k-th best score of every query so far."""
        self._merge()
        return self.floor

    def frame(self, query_ids: np.ndarray) -> pd.DataFrame:
        self._merge()
        ids = self.ids if self.ids is not None else np.zeros(0, np.int64)
        return pd.DataFrame({"query_id": query_ids[self.row], "chunk_id": ids, "score": self.score})


def top_k(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = TOP_K_SEARCH,
    chunk_id: str = "chunk_id",
    query_id: str = "query_id",
    vector: str = "embedding",
    max_shipped_floats: int = MAX_SHIPPED_FLOATS,
    n_pivots: int | None = None,
    block_rows: int = 4096,
) -> DataFrame:
    """(query_id, chunk_id, score, hit_rank): the k best chunks of each query among those of its dimension."""
    k = max(1, k)
    # Vectors of 32-bit numbers travel as they are; tasks compute in double precision.
    floats = all(isinstance(getattr(df.schema[vector].dataType, "elementType", None), T.FloatType) for df in (chunks, queries))
    v = F.col(vector) if floats else F.col(vector).cast("array<double>")
    left = chunks.select(F.col(chunk_id).alias("chunk_id"), v.alias("v"))
    right = queries.select(F.col(query_id).alias("query_id"), v.alias("v"))
    left, right = left.where(F.size("v") > 0), right.where(F.size("v") > 0)
    size = right.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("n")).first()["n"]
    if size <= max_shipped_floats:
        found = _scan_with_queries(left, right, k)
    else:
        found = _match_cells(left, right, k, n_pivots, block_rows)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("hit_rank", F.row_number().over(w)).where(F.col("hit_rank") <= k)


def _result_schema(chunks: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _scan_with_queries(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    batch = queries.toPandas()  # bounded: its size was checked
    by_dim = {
        int(d): (g["query_id"].to_numpy(), _unit(_matrix(g["v"])))
        for d, g in batch.groupby(batch["v"].map(len))
    }
    shipped = chunks.sparkSession.sparkContext.broadcast(by_dim)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, _Nearest] = {}
        for frame in frames:
            for dim, part in frame.groupby(frame["v"].map(len)):
                dim = int(dim)
                if dim not in shipped.value:
                    continue
                if dim not in best:
                    best[dim] = _Nearest(shipped.value[dim][1], k)
                best[dim].add(_unit(_matrix(part["v"])), part["chunk_id"].to_numpy())
        for dim, nearest in best.items():
            yield nearest.frame(shipped.value[dim][0])

    return chunks.mapInPandas(scan, _result_schema(chunks, queries))


def _runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Stretches of rows with equal keys; a key's rows may come in several."""
    for frame in frames:
        if not len(frame):
            continue
        change = np.ones(len(frame), bool)
        change[1:] = (frame[keys].to_numpy()[1:] != frame[keys].to_numpy()[:-1]).any(axis=1)
        edges = [*np.flatnonzero(change).tolist(), len(frame)]
        for i, j in zip(edges[:-1], edges[1:]):
            yield tuple(frame[keys].iloc[i]), frame.iloc[i:j]


class Cells:
    """Pivots of each vector length, and of every cell the number of its rows, their least and greatest distance from
    the pivot and their ``k`` least distances."""

    def __init__(self, pivots: dict[int, tuple[int, np.ndarray]]):
        self.pivots = pivots

    def gather(self, n_queries: dict[int, int]) -> None:
        """Put pivots around the first few of them: neighbouring cells, about as many groups as there are slices."""
        self.home, self.groups = {}, 0
        for dim, (first, p) in self.pivots.items():
            few = min(len(p), max(1, round(n_queries.get(dim, 0) * dim / SLICE_FLOATS)))
            self.home[dim] = first + np.argmax(p @ p[:few].T, axis=1)
            self.groups += few + 1

    def know(self, rows: list) -> None:
        found = {r["cell"]: r for r in rows}
        self.n = {c: r["n"] for c, r in found.items()}
        self.lo, self.hi, self.near = {}, {}, {}
        for dim, (first, p) in self.pivots.items():
            cells = range(first, first + len(p))
            self.lo[dim] = np.array([found[c]["lo"] if c in found else np.inf for c in cells])
            self.hi[dim] = np.array([found[c]["hi"] if c in found else -np.inf for c in cells])
            width = max((len(found[c]["near"]) for c in cells if c in found), default=1)
            self.near[dim] = np.full((len(p), width), np.inf)
            for i, c in enumerate(cells):
                if c in found:
                    self.near[dim][i, : len(found[c]["near"])] = found[c]["near"]

    def distances(self, unit: np.ndarray, dim: int) -> np.ndarray:
        """Zero vectors score 0 against everything: distance sqrt(2), as for a right angle."""
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (unit @ self.pivots[dim][1].T)))

    def reach(self, d: np.ndarray, dim: int, k: int) -> np.ndarray:
        """How far a hit can be at most, told by the least distances in the cells around a query."""
        close = np.argsort(d, axis=1)[:, :NEAR_CELLS]
        upper = (np.take_along_axis(d, close, axis=1)[:, :, None] + self.near[dim][close]).reshape(len(d), -1)
        return np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] >= k else np.full(len(d), np.inf)

    def wanted(self, unit: np.ndarray, dim: int, theta: np.ndarray) -> dict[int, tuple[float, float]]:
        """Cells that may hold a hit of some of these queries, with the distances from the pivot where it would lie."""
        first, p = self.pivots[dim]
        low, high = np.full(len(p), np.inf), np.full(len(p), -np.inf)
        step = max(1, TILE_SCORES // len(p))
        for at in range(0, len(unit), step):
            d, t = self.distances(unit[at : at + step], dim), theta[at : at + step, None] + SLACK
            meets = (d - self.hi[dim] <= t) & (self.lo[dim] - d <= t)
            low = np.minimum(low, np.where(meets, d - t, np.inf).min(axis=0))
            high = np.maximum(high, np.where(meets, d + t, -np.inf).max(axis=0))
        return {first + int(i): (float(low[i]), float(high[i])) for i in np.flatnonzero(low < np.inf)}


def _zero_cell(dim: int) -> int:
    """Bounds do not hold for zero vectors: theirs is a cell that is always visited."""
    return -1 - dim


def _meetings(chunks: DataFrame, queries: DataFrame, k: int, n_pivots: int | None, block_rows: int) -> DataFrame:
    """Queries and rows that have to meet, dealt by (home, slice, part): those with flag 0 are a part's queries.

    Both sides lie around pivots, and the rows are told in two passes.  First the queries of a home (some neighbouring cells), in slices of
    bounded size, meet a block of the same cells' rows; their k-th best there bounds how far a hit can be.  Then a slice meets, of those cells that its bounds reach, the rows whose distance from
    the pivot fits; a row goes to a slice at most once, and a query once to each part of its slice's rows.
    """
    spark = chunks.sparkSession
    pivots, first = {}, 0
    for r in sorted(chunks.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()):  # a row for each vector length
        size = n_pivots or min(MAX_PIVOTS, max(8, math.isqrt(r["n"])))
        taken = chunks.where(F.size("v") == r["dim"]).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(size).select("v").toPandas()
        pivots[r["dim"]] = (first, _unit(_matrix(taken["v"])))
        first += len(taken)
    geometry = Cells(pivots)
    geometry.gather({r["dim"]: r["n"] for r in queries.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()})

    def around(part: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors, home cells and distances from their pivots."""
        unit = _unit(_matrix(part["v"]))
        home, dist = np.empty(len(part), np.int64), np.empty(len(part))
        step = max(1, TILE_SCORES // len(geometry.pivots[dim][1]))
        for at in range(0, len(part), step):
            d = geometry.distances(unit[at : at + step], dim)
            home[at : at + step], dist[at : at + step] = geometry.pivots[dim][0] + d.argmin(axis=1), d.min(axis=1)
        home[~unit.any(axis=1)] = _zero_cell(dim)
        return unit, home, dist

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["v"].map(len)):
                _, home, dist = around(part, int(dim))
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "v": part["v"].to_numpy(), "cell": home, "dist": dist})

    cell_schema = T.StructType([*chunks.schema.fields, T.StructField("cell", T.LongType()), T.StructField("dist", T.DoubleType())])
    placed = cut_lineage(chunks.mapInPandas(assign, cell_schema))

    def summarize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for frame in frames:
            for cell, dist in frame.groupby("cell")["dist"]:
                n, lo, hi, near = held.get(cell, (0, np.inf, -np.inf, np.zeros(0)))
                near = np.sort(np.concatenate([near, dist.to_numpy()]))[:k]
                held[cell] = (n + len(dist), min(lo, dist.min()), max(hi, dist.max()), near)
        yield pd.DataFrame([(c, *v) for c, v in held.items()], columns=["cell", "n", "lo", "hi", "near"])

    partial = placed.select("cell", "dist").mapInPandas(summarize, "cell long, n long, lo double, hi double, near array<double>")
    merged = partial.groupBy("cell").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near")
    )
    geometry.know(merged.collect())  # a row for each pivot, and one for zero vectors of each length
    shared = spark.sparkContext.broadcast(geometry)
    homes = {first + i: int(home) for dim, (first, _) in pivots.items() for i, home in enumerate(geometry.home[dim])}
    around_home: dict[int, int] = {}
    for c, n in geometry.n.items():
        around_home[homes.get(c, c)] = around_home.get(homes.get(c, c), 0) + n
    cells = spark.createDataFrame(
        [(c, homes.get(c, c), -(-around_home[homes.get(c, c)] // block_rows)) for c in geometry.n], "cell long, home long, blocks long"
    )

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["v"].map(len)):
                if int(dim) in shared.value.pivots:
                    _, home, _ = around(part, int(dim))
                    some = home >= 0
                    home[some] = geometry.home[int(dim)][home[some] - geometry.pivots[int(dim)][0]]
                    yield pd.DataFrame({"query_id": part["query_id"].to_numpy(), "v": part["v"].to_numpy(), "home": home})

    asked = cut_lineage(queries.mapInPandas(ask, T.StructType([*queries.schema.fields, T.StructField("home", T.LongType())])))
    size = F.round(F.sum(F.size("v")) / SLICE_FLOATS).cast("long")
    slices = asked.groupBy("home").agg(F.greatest(F.lit(1), size).alias("slices"))  # a row for each pivot at most
    sliced = asked.join(F.broadcast(slices), "home").withColumn("slice", F.pmod(F.xxhash64("query_id"), F.col("slices")))

    # First pass: one block of the home's rows.
    block = placed.join(F.broadcast(cells), "cell").where(F.pmod(F.xxhash64("chunk_id"), F.col("blocks")) == 0)
    block = block.join(F.broadcast(slices), "home").withColumn("slice", F.explode(F.expr("sequence(0l, slices - 1)")))
    keys = ["home", "slice"]
    met = sliced.select(*keys, F.lit(0).alias("flag"), "v").unionByName(block.select(*keys, F.lit(1).alias("flag"), "v"))
    met = met.repartition(*keys).sortWithinPartitions(*keys, "flag")

    def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value

        def close(key: tuple, held: list[np.ndarray], best: _Nearest | None) -> pd.DataFrame:
            unit = np.concatenate(held)
            dim = unit.shape[1]
            if key[0] == _zero_cell(dim):
                found = {c: (-np.inf, np.inf) for c in known.n if c == _zero_cell(dim) or 0 <= c - known.pivots[dim][0] < len(known.pivots[dim][1])}
            else:
                theta = np.concatenate([
                    known.reach(known.distances(unit[at : at + REACH_ROWS], dim), dim, k) for at in range(0, len(unit), REACH_ROWS)
                ])
                if best is not None:
                    theta = np.minimum(theta, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * best.floors())))
                found = known.wanted(unit, dim, theta)
                if _zero_cell(dim) in known.n:
                    found[_zero_cell(dim)] = (-np.inf, np.inf)
            rows = [(*key, c, lo, hi, known.n[c], known.n[c] * dim) for c, (lo, hi) in found.items() if c in known.n]
            return pd.DataFrame(rows, columns=["home", "slice", "cell", "lo", "hi", "n", "floats"])

        now, held, best = None, [], None
        for (*key, flag), part in _runs(frames, [*keys, "flag"]):
            if tuple(key) != now:
                if held:
                    yield close(now, held, best)
                now, held, best = tuple(key), [], None
            unit = _unit(_matrix(part["v"]))
            if flag == 0:
                held.append(unit)
            elif held:
                best = best or _Nearest(np.concatenate(held), k)
                best.add(unit, np.arange(len(unit)))
        if held:
            yield close(now, held, best)

    wanted = cut_lineage(met.mapInPandas(bound, "home long, slice long, cell long, lo double, hi double, n long, floats long"))

    # Second pass: the rows that the bounds reach, in parts of bounded size.
    n_slices = wanted.select(*keys).distinct().count()
    enough = -(-3 * spark.sparkContext.defaultParallelism // max(1, n_slices))  # parts that keep all cores busy
    by_size, short = F.ceil(F.sum("floats") / PART_FLOATS), F.floor(F.sum("n") / SHORT_PART_ROWS)
    parts = wanted.groupBy(*keys).agg(F.greatest(F.lit(1), by_size, F.least(F.lit(enough), short)).alias("parts"))
    reached = wanted.drop("n", "floats").join(parts, keys)
    if n_slices * len(geometry.n) <= MAX_BROADCAST_ROWS:
        parts, reached = F.broadcast(parts), F.broadcast(reached)
    right = sliced.join(parts, keys).withColumn("part", F.explode(F.expr("sequence(0l, parts - 1)")))
    left = placed.join(reached, "cell").where("dist between lo and hi").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")))
    keys.append("part")
    def blank(rows: DataFrame, name: str) -> Column:
        kind = rows.schema[name].dataType
        return F.lit(0 if isinstance(kind, T.NumericType) else "").cast(kind)  # not NULL: ids stay whole numbers

    return right.select(*keys, F.lit(0).alias("flag"), "query_id", blank(chunks, "chunk_id").alias("chunk_id"), "v").unionByName(
        left.select(*keys, F.lit(1).alias("flag"), blank(queries, "query_id").alias("query_id"), "chunk_id", "v")
    )


def _match_cells(chunks: DataFrame, queries: DataFrame, k: int, n_pivots: int | None, block_rows: int) -> DataFrame:
    both, keys = _meetings(chunks, queries, k, n_pivots, block_rows), ["home", "slice", "part"]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, ids, best = None, [], [], None
        for (*key, flag), part in _runs(frames, [*keys, "flag"]):
            if tuple(key) != now:
                if best is not None:
                    yield best.frame(np.concatenate(ids))
                now, held, ids, best = tuple(key), [], [], None
            unit = _unit(_matrix(part["v"]))
            if flag == 0:
                held.append(unit)
                ids.append(part["query_id"].to_numpy())
            elif held:
                best = best or _Nearest(np.concatenate(held), k)
                best.add(unit, part["chunk_id"].to_numpy())
        if best is not None:
            yield best.frame(np.concatenate(ids))

    return both.repartition(*keys).sortWithinPartitions(*keys, "flag").mapInPandas(score, _result_schema(chunks, queries))


def hit_block(rank: Column, score: Column, path: Column, text: Column) -> Column:
    return F.format_string(
        "[#%d score=%s path=%s]\n%s", rank.cast("int"), fixed(score, 4), F.coalesce(path, F.lit("?")), text
    )


def chat_hit_line(rank: Column, score: Column, path: Column, text: Column, snippet: int = 520) -> Column:
    short = F.substring(F.regexp_replace(text, f"{WS}+", " "), 1, snippet)
    more = F.when(F.length(text) > snippet, " …").otherwise("")
    return F.format_string(
        "#%d score=%s — %s\n%s", rank.cast("int"), fixed(score, 3), F.coalesce(path, F.lit("?")), F.concat(short, more)
    )


def fixed(c: Column, digits: int) -> Column:
    """A number with a fixed count of decimals and no grouping."""
    return F.regexp_replace(F.format_number(c, digits), ",", "")
