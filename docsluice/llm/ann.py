"""Nearest neighbours by largest inner product over balanced posting lists.

Inner products become distances by one more component that lifts every vector to one norm.  A bounded sample is split
in two again and again until the parts are small, which gives balanced lists; each list has its centre.  Every vector
is stored in its nearest list and, if it lies near a boundary, in further lists whose centres are about as near and do
not lie behind a list it already is in.  Centres are searched over a neighbourhood graph held in memory by each task.
A query reads the lists whose centres are within a ratio of its nearest centre; the ratio is what the sample needs for
the wanted recall, and no cap stands beside it.  Vectors longer than the sample's longest stand in one list that every
query reads.

Lists are gathered into shards of bounded size (a longer list is split), shards are met by the stream of queries that
chose them, and scores are computed in double precision from the original vectors.

Equal vectors are one candidate that stands for its k + 1 smallest ids, which is all that any result can show; equal
queries are searched once.  Ties of score go to the smaller id.  Vectors that are null, empty, zero or hold null or
non-finite components, and rows without an id, take no part; lengths are searched apart.  Repeated rows of an id count
once.  An empty table gives an empty result.  Columns of other names play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.llm.common import checkpoint
from docsluice.llm.vectors import blocks_and_streams, distances, matrix, sample, usable

SAMPLE = 20_000  # vectors that lists and the pruning ratio are fitted on
LIST_ROWS = 256  # wanted vectors of a list
MAX_LISTS = 8192  # centres held by a task: 8192 x (dim + 1) doubles
REPLICAS, BOUNDARY = 3, 1.1  # lists of a boundary vector; how much farther than the nearest they may be
NEIGHBOURS, POOL = 16, 64  # edges of a centre; least candidates of a graph search
CALIBRATION, RECALL = 400, 0.97  # sample queries that set the ratio, and the recall they must reach
SHARD_ROWS = 8192  # vectors held together when a shard is scored
PAIRS = 100_000  # exact products computed at once
BLOCK_ROWS = 128  # vectors that meet all centres, or queries that meet the whole sample, at once


@dataclass
class Index:
    """Centres with their graph, the square of the common norm, and the pruning ratio."""

    centres: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    top2: float
    ratio: float = 1.0


def lift(x: np.ndarray, top2: float) -> np.ndarray:
    """Stored vectors, lifted to one norm; those longer than the sample's longest have none (``longer``)."""
    return np.hstack([x, np.sqrt(np.maximum(0, top2 - (x * x).sum(1)))[:, None]])


def longer(x: np.ndarray, top2: float) -> np.ndarray:
    """Vectors longer than the sample's longest: no list is fit for them, so every query meets them."""
    return (x * x).sum(1) > top2


def lift_queries(q: np.ndarray, top2: float) -> np.ndarray:
    """Only a query's direction matters; it is given the common norm."""
    return np.hstack([q * (np.sqrt(top2) / np.linalg.norm(q, axis=1, keepdims=True)), np.zeros((len(q), 1))])


def balanced_lists(x: np.ndarray, rows: int, seed: int = 3) -> np.ndarray:
    """Centres of parts of at most ``rows`` points, each made by halving a part along its two centres."""
    rng, todo, centres = np.random.default_rng(seed), [np.arange(len(x))], []
    while todo:
        part = todo.pop()
        p = x[part]
        if len(part) <= rows or (p == p[0]).all():
            centres.append(p.mean(0))
            continue
        a, b = p[rng.choice(len(p), 2, replace=False)]
        for _ in range(6):
            side = distances(p, np.stack([a, b])) @ np.array([1, -1])
            order = np.argsort(side, kind="stable")
            a, b = p[order[: len(p) // 2]].mean(0), p[order[len(p) // 2 :]].mean(0)
        todo += [part[order[: len(p) // 2]], part[order[len(p) // 2 :]]]
    return np.unique(np.array(centres), axis=0)


def neighbour_graph(centres: np.ndarray) -> np.ndarray:
    """Nearest centres of each, and some far ones that keep the graph in one piece."""
    k = len(centres)
    near = min(NEIGHBOURS, k - 1)
    out = np.zeros((k, max(1, near + 4)), np.int64)
    far = np.random.default_rng(1).integers(0, k, (k, 3)) if k else out
    for i in range(0, k, BLOCK_ROWS):
        d = distances(centres[i : i + BLOCK_ROWS], centres)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + BLOCK_ROWS, :near] = np.argsort(d, axis=1, kind="stable")[:, :near]
    if k:
        out[:, near : near + 3] = far[:, : out.shape[1] - near]
        out[:, -1] = (np.arange(k) + 1) % k  # a ring reaches every centre
    return out


def search_centres(index: Index, q: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of each row to the centres that a graph search met (others inf), and the nearest's.

    Best first over the graph: a row's nearest unread centre is read as long as it is within the ratio of the nearest
    centre so far or among the POOL nearest met.  Holds a number for every row and centre: callers bound the rows.
    """
    n, k = len(q), len(index.centres)
    d = np.full((n, k), np.inf)
    read = np.zeros((n, k), bool)
    d[:, index.entries] = distances(q, index.centres[index.entries])
    live = np.arange(n)
    norms = (index.centres**2).sum(1)
    while len(live):
        open_d = np.where(read[live], np.inf, d[live])
        best = open_d.argmin(1)
        low = open_d[np.arange(len(live)), best]
        nearest = d[live].min(1)
        met = d[live]
        rank = (met < low[:, None]).sum(1)
        go = np.isfinite(low) & ((low <= nearest * ratio * ratio) | (rank < POOL))
        live, best = live[go], best[go]
        read[live, best] = True
        next_ = index.graph[best]
        new = np.maximum(0, (q[live] ** 2).sum(1)[:, None] - 2 * np.einsum("nd,ned->ne", q[live], index.centres[next_]) + norms[next_])
        d[live[:, None], next_] = new
    return d, d.min(1)


def store_in(index: Index, x: np.ndarray) -> list[np.ndarray]:
    """Lists of each stored vector: the nearest, and boundary lists that no chosen list stands in front of."""
    out = []
    for at in range(0, len(x), BLOCK_ROWS):
        d, nearest = search_centres(index, x[at : at + BLOCK_ROWS], BOUNDARY)
        for row, low in zip(d, nearest):
            near = np.flatnonzero(row <= low * BOUNDARY**2)
            chosen: list[int] = []
            for c in near[np.argsort(row[near], kind="stable")]:
                if len(chosen) == REPLICAS:
                    break
                gaps = distances(index.centres[c][None], index.centres[chosen])[0] if chosen else np.zeros(0)
                if (gaps >= row[c]).all():
                    chosen.append(int(c))
            out.append(np.array(chosen, np.int64))
    return out


def choose_lists(index: Index, q: np.ndarray) -> list[np.ndarray]:
    """Lists of each query: all within the ratio of the nearest."""
    out = []
    for at in range(0, len(q), BLOCK_ROWS):
        d, nearest = search_centres(index, q[at : at + BLOCK_ROWS], index.ratio)
        out += [np.flatnonzero(row <= low * index.ratio**2) for row, low in zip(d, nearest)]
    return out


def build_index(x: np.ndarray, total: int, k: int) -> Index:
    """Fit on a sample of ``total`` vectors.  The driver holds the sample and centres, and blocks of rows beside them."""
    top2 = float((x * x).sum(1).max()) * (1 + 1e-9)
    lists = min(MAX_LISTS, max(1, total // LIST_ROWS))
    lifted = lift(x, top2)
    centres = balanced_lists(lifted, max(2, -(-len(x) // lists)))
    entries = np.unique(np.linspace(0, len(centres) - 1, 16).astype(int))
    index = Index(centres, neighbour_graph(centres), entries, top2)
    # The ratio that reaches the wanted recall: for each true neighbour, how far the nearest of its lists is.
    asked = np.unique(np.linspace(0, len(x) - 1, CALIBRATION).astype(int))
    near: list[np.ndarray] = []
    for at in range(0, len(asked), BLOCK_ROWS):
        some = asked[at : at + BLOCK_ROWS]
        scores = x[some] @ x.T
        scores[np.arange(len(some)), some] = -np.inf
        near += [np.argsort(-row)[: min(k, len(x) - 1)] for row in scores]
    met = np.unique(np.concatenate(near))
    stored = dict(zip(met.tolist(), store_in(index, lifted[met])))
    need = []
    for at in range(0, len(asked), BLOCK_ROWS):
        d = np.sqrt(distances(lift_queries(x[asked[at : at + BLOCK_ROWS]], top2), centres))
        low = np.maximum(d.min(1), 1e-12)
        need += [row[stored[j]].min() / least for row, least, own in zip(d, low, near[at : at + BLOCK_ROWS]) for j in own.tolist()]
    index.ratio = float(np.quantile(need, RECALL)) * (1 + 1e-9) if need else 1.0
    return index


def search(rows: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", recall_index: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``is_query`` holds."""
    spark = rows.sparkSession
    fit = usable(F.col(vector)) & F.col(id_column).isNotNull()
    good = rows.where(fit).select(F.col(id_column).cast("long").alias("i"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    good = checkpoint(good.groupBy("i").agg(F.min(F.struct("v", "q")).alias("r")).select("i", "r.v", "r.q"))
    first = Window.partitionBy("v").orderBy("i")
    short = good.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    stored = checkpoint(short.groupBy("v").agg(F.min("i").alias("id"), F.sort_array(F.collect_list("i")).alias("ids")))  # at most k + 1 ids
    asked = good.where("q").join(stored.select("v", "id"), "v").select(F.col("i").alias("query_id"), "id")
    wanted = checkpoint(asked.select("id").distinct().join(stored.select("id", "v"), "id"))
    found = None
    for row in stored.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():  # one row per vector length
        dim = row["dim"]
        mine = _search_one(stored.where(F.size("v") == dim), wanted.where(F.size("v") == dim), row["count"], k, recall_index)
        found = mine if found is None else found.unionAll(mine)
    if found is None:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    # Replicas of a vector meet here; k + 1 distinct vectors per query vector are enough.
    near = found.distinct().withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    hits = near.join(stored.select("id", "ids"), "id").select("q", "score", F.explode("ids").alias("vec_id"))
    hits = hits.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    lists = hits.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id", "score"))).alias("hits"))  # k + 1
    per_query = asked.join(lists, asked["id"] == lists["q"]).select("query_id", F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")).alias("hits"))
    ranked = per_query.select("query_id", F.posexplode(F.slice("hits", 1, k)).alias("p", "h"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"))


def best_rows(q: np.ndarray, x: np.ndarray, ids: np.ndarray, take: int, length: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``take`` rows of largest inner product of each query, ties to the smaller id.

    The matrix product, whose sums are rounded in an order of its own, only tells which rows may be among them: those at
    or above the last of them less a margin.  These are summed in one order, so a vector scores the same wherever it is
    stored, and ranked by that.  ``length`` is that of the longest row.
    """
    rough = q @ x.T
    least = np.partition(rough, len(ids) - take, axis=1)[:, len(ids) - take]
    margin = 1e-13 * x.shape[1] * length * np.sqrt((q * q).sum(1))
    row, hit = np.nonzero(rough >= (least - margin)[:, None])
    exact = np.concatenate([(q[row[i : i + PAIRS]] * x[hit[i : i + PAIRS]]).sum(-1) for i in range(0, len(row), PAIRS)])
    order = np.lexsort((ids[hit], -exact, row))
    row, hit, exact = row[order], hit[order], exact[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < take], hit[rank < take], exact[rank < take]


def _numbers(values: list[int]) -> Column:
    """An array of constants that is one literal of the plan, however many there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _search_one(stored: DataFrame, wanted: DataFrame, total: int, k: int, sample_size: int) -> DataFrame:
    spark = stored.sparkSession
    index = build_index(sample(stored, "v", "id", sample_size), total, k)
    shared = spark.sparkContext.broadcast(index)
    kind = stored.schema["v"].dataType.elementType.simpleString()

    def spread(query: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    x, idx = matrix(some.column(1)), shared.value
                    if query:
                        lists = [np.append(c, len(idx.centres)) for c in choose_lists(idx, lift_queries(x, idx.top2))]
                    else:
                        lists = store_in(idx, lift(x, idx.top2))
                        for i in np.flatnonzero(longer(x, idx.top2)):
                            lists[i] = np.array([len(idx.centres)], np.int64)
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(lists, pa.list_(pa.int64()))], ["id", "v", "lists"])

        return work

    schema = f"id long, v array<{kind}>, lists array<long>"
    held = checkpoint(stored.select("id", "v").mapInArrow(spread(False), schema))
    asking = wanted.select("id", "v").mapInArrow(spread(True), schema)
    # Shards: neighbouring lists together up to SHARD_ROWS, longer lists in parts.  At most MAX_LISTS + 1 counts come
    # here; the last list holds the vectors that every query meets and has a shard of its own.
    sizes = {r["list"]: r["n"] for r in held.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect()}
    shard_of, parts, shard, rows = {}, {}, 0, 0
    for c in sorted(sizes):
        if rows and (rows + sizes[c] > SHARD_ROWS or c == len(index.centres)):
            shard, rows = shard + 1, 0
        shard_of[c], parts[shard] = shard, max(parts.get(shard, 1), -(-sizes[c] // SHARD_ROWS))
        rows += sizes[c]
    table = _numbers([shard_of.get(c, -1) for c in range(len(index.centres) + 1)])
    many = _numbers([parts.get(s, 1) for s in range(shard + 1)])
    shards = F.array_distinct(F.filter(F.transform("lists", lambda c: F.element_at(table, (c + 1).cast("int"))), lambda s: s >= 0))
    keyed = held.select("id", "v", F.explode(shards).alias("shard"))
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("id"), F.element_at(many, F.col("shard") + 1)).cast("int"))
    queries = asking.select("id", "v", F.explode(shards).alias("shard"))
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(many, F.col("shard") + 1) - 1)))
    both = keyed.select("shard", "part", F.lit(0).alias("flag"), "id", "v").unionAll(queries.select("shard", "part", F.lit(1).alias("flag"), "id", "v"))

    def score(key: tuple, block: list[pa.RecordBatch], stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not block:
            return
        x, ids = np.concatenate([matrix(b.column(4)) for b in block]), np.concatenate([b.column(3).to_numpy() for b in block])
        take, length = min(k + 1, len(ids)), np.sqrt((x * x).sum(1)).max()
        for passing in stream:
            for at in range(0, passing.num_rows, 256):
                some = passing.slice(at, 256)
                q = matrix(some.column(4))
                row, hit, exact = best_rows(q, x, ids, take, length)
                yield pa.RecordBatch.from_arrays([some.column(3).take(pa.array(row)), pa.array(ids[hit]), pa.array(exact)], ["q", "id", "score"])

    return both.repartition("shard", "part").sortWithinPartitions("shard", "part", "flag").mapInArrow(blocks_and_streams(2, score), "q long, id long, score double")
