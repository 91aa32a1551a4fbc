"""Near-duplicate vectors by an inverted multi-index: two codebooks on vector halves, whose product is a grid of cells.

Unit vectors are put into the cell of their halves' nearest codewords.  From a vector, cells are visited in the order of
growing distance bound (the multi-sequence order): in each half the distance to a codeword's region is at least the
distance to the plane between that codeword and the vector's own, so cells whose two bounds together exceed the search
radius hold no partner.  With ``recall`` 1 the traversal ends at the full radius and misses nothing; a smaller target
ends it at the radius within which that share of a bounded sample's close pairs have their cells.  Every pair met is
verified in double precision.  Neighbouring cells are gathered into shards, so a vector travels once to all the cells it
visits there, and shards of a label are split into blocks of bounded size; a pair meets once, in the later shard.

Exact copies (same label and components) are one vector with a weight, so copies are never expanded into pairs.  Of a
block only sums of links and one edge per vector to its local group's least id leave the task.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without label or vec_id, link with
nothing.  Vectors of different lengths do not link.  Repeated rows of a vec_id count once (the least vector stands).
An empty table gives an empty result.  Columns other than vec_id, embedding and label play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.llm.common import checkpoint, components
from docsluice.llm.vectors import blocks_and_streams, distances, kmeans, matrix, sample, usable

LEAST = 0.93  # cosine from which two vectors are linked
SAMPLE = 20_000  # vectors that codebooks are fitted on
CELL_ROWS, MAX_WORDS = 64, 256  # wanted vectors of a label in a cell; codewords of a half
BLOCK = 1024  # vectors of a shard that are held together
SLACK = 1e-7  # rounding of distances to planes


def plane_bounds(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest codeword, and squared lower bounds of its distance to every codeword's region."""
    d = distances(x, words)
    home = d.argmin(1)
    apart = np.sqrt(distances(words, words))[home]
    low = np.divide(d - d[np.arange(len(x)), home][:, None], 2 * apart, out=np.zeros_like(d), where=apart > 0)
    return home, np.maximum(0, low - SLACK) ** 2


def traversal(low_a: np.ndarray, low_b: np.ndarray, radius2: float) -> np.ndarray:
    """Cells (a * words + b) in the order of growing bound sum, up to the squared radius: the multi-sequence order."""
    near_a, near_b = np.flatnonzero(low_a <= radius2), np.flatnonzero(low_b <= radius2)
    total = low_a[near_a][:, None] + low_b[near_b]
    ok = np.argwhere(total <= radius2)
    order = np.argsort(total[ok[:, 0], ok[:, 1]], kind="stable")
    return near_a[ok[order, 0]] * len(low_b) + near_b[ok[order, 1]]


def local_groups(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' group under edges a-b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _half(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cut = (v.shape[1] + 1) // 2
    return unit[:, :cut], unit[:, cut:] if v.shape[1] > 1 else np.zeros((len(v), 1))


def _reach(words: tuple[np.ndarray, np.ndarray], taken: np.ndarray, radius2: float, recall: float) -> float:
    """The squared bound up to which traversal visits the cells of ``recall`` of the sample's close pairs."""
    if recall >= 1 or len(taken) < 2:
        return radius2
    a, b = _half(taken)
    (ha, la), (hb, lb) = plane_bounds(a, words[0]), plane_bounds(b, words[1])
    unit, found = np.hstack([a, b]), []
    for i in range(0, len(unit), 1024):
        x, y = np.nonzero(unit[i : i + 1024] @ unit.T >= 1 - radius2 / 2)
        x += i
        found.append((la[x, ha[y]] + lb[x, hb[y]])[x != y])
    bounds = np.concatenate(found)
    return float(np.quantile(bounds, recall)) + 1e-12 if len(bounds) else radius2


def links(vectors: DataFrame, least: float = LEAST, recall: float = 1.0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of distinct vectors (id, label, weight, v): (id, n) sums of linked weights, and (a, b) edges that join the groups."""
    spark = vectors.sparkSession
    radius2 = max(0.0, 2 - 2 * least)
    books = {}
    largest = vectors.groupBy(F.size("v").alias("dim"), "label").count().groupBy("dim").agg(F.max("count").alias("n"))
    for row in largest.collect():  # one row per vector length
        dim, n = row["dim"], row["n"]
        words = min(MAX_WORDS, max(1, math.isqrt(n // CELL_ROWS)))
        taken = sample(vectors.where(F.size("v") == dim), "v", "id", SAMPLE)
        taken = taken / np.linalg.norm(taken, axis=1, keepdims=True)
        pair = tuple(kmeans(h, words) for h in _half(taken))
        # Shards are runs of cells that hold about equal shares of the sample.
        (ha, _), (hb, _) = (plane_bounds(h, w) for h, w in zip(_half(taken), pair))
        size = np.bincount(ha * len(pair[1]) + hb, minlength=len(pair[0]) * len(pair[1]))
        shard_of = (np.cumsum(size) - size) * -(-n // block) // max(1, size.sum())
        books[dim] = (pair, _reach(pair, taken, radius2, recall), shard_of)
    shared = spark.sparkContext.broadcast(books)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    (wa, wb), reach, shard_of = shared.value[int(dim)]
                    a, b = _half(matrix(some.column(3)))
                    (ha, la), (hb, lb) = plane_bounds(a, wa), plane_bounds(b, wb)
                    home = shard_of[ha * len(wb) + hb]
                    visited = (np.unique(shard_of[traversal(x, y, reach)]) for x, y in zip(la, lb))
                    later = [c[c >= h] for c, h in zip(visited, home)]
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(home), pa.array(later, pa.list_(pa.int64()))], ["id", "label", "w", "v", "home", "shards"])

    kind = vectors.select("id", "label", F.col("weight").alias("w"), "v")
    placed = checkpoint(kind.mapInArrow(place, f"id long, label long, w long, v array<{vectors.schema['v'].dataType.elementType.simpleString()}>, home long, shards array<long>"))
    placed = placed.withColumn("dim", F.size("v"))
    sizes = placed.groupBy("label", "dim", F.col("home").alias("shard")).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    keys = ["label", "dim", "shard"]
    homes = placed.drop("shards").withColumnRenamed("home", "shard").join(sizes, keys)
    homes = homes.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    visits = placed.select("id", "w", "v", "label", "dim", "home", F.explode("shards").alias("shard")).join(sizes, keys)
    visits = visits.withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # In its own shard a vector visits the later blocks; its own block is compared within.
    visits = visits.where("shard <> home or part > own")
    columns = ["label", "dim", "shard", "part"]
    rows = homes.select(*columns, F.lit(0).alias("flag"), "id", "w", "v").unionAll(visits.select(*columns, F.lit(1).alias("flag"), "id", "w", "v"))

    def unit(batch: pa.RecordBatch) -> np.ndarray:
        v = matrix(batch.column(7))
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def out(ids: np.ndarray, n: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(group)], ["id", "n", "other"])

    def meet(key: tuple, held: list[pa.RecordBatch], stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        x, ids = np.concatenate([unit(b) for b in held]), np.concatenate([b.column(5).to_numpy() for b in held])
        w = np.concatenate([b.column(6).to_numpy() for b in held])
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        n = near @ w
        a, b = np.nonzero(np.triu(near, 1))
        yield from _edges(ids, n, a, b, len(ids))
        for passing in stream:
            for at in range(0, passing.num_rows, 1024):
                some = passing.slice(at, 1024)
                y, their, v = unit(some), some.column(5).to_numpy(), some.column(6).to_numpy()
                near = y @ x.T >= least
                if not near.any():
                    continue
                a, b = np.nonzero(near)
                yield from _edges(np.concatenate([their, ids]), np.concatenate([near @ w, v @ near]), a, b + len(their), len(their) + len(ids))

    def _edges(ids: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
        order = np.argsort(ids, kind="stable")  # so the least position of a group is its least id
        rank = np.empty(size, np.int64)
        rank[order] = np.arange(size)
        group = ids[order][local_groups(size, rank[a], rank[b])][rank]
        some = n > 0
        if some.any():
            yield out(ids[some], n[some].astype(np.int64), group[some])

    met = checkpoint(rows.repartition(*columns).sortWithinPartitions(*columns, "flag").mapInArrow(blocks_and_streams(4, meet), "id long, n long, other long"))
    return met.groupBy("id").agg(F.sum("n").alias("n")), met.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()


def near_duplicates(embeddings: DataFrame, least: float = LEAST, recall: float = 1.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per vector."""
    rows = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    fit = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    one = rows.where(fit).groupBy("vec_id").agg(F.min(F.struct("label", F.col("embedding").alias("v"))).alias("r")).select("vec_id", "r.label", "r.v")
    groups = checkpoint(one.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    sums, edges = links(groups, least, recall)
    reached = components(edges)
    known = groups.join(sums, "id", "left").join(reached.withColumnRenamed("node", "id"), "id", "left").select(
        "label", "v", (F.coalesce(F.col("n"), F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    linked = one.join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    return rows.select("vec_id").join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
