"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct word shingles; its sketch is the k least of them.  Equal sets are one
set that stands for its documents.  Two sets that are similar enough share at least t retained values (``least_shared``:
7 of 20 at 80 percent, missed about twice in a million times; never for sets of at most k shingles).  A set's values are
put in order of how many sets retain them, rarest first.  Of two sets that share t, the j-th value that they share is
among the first k - t + j of both, so an inverted list per value holds a set under its k - t + 1 rarest values only, and
values of frequent lines and passages make no list as long as a set has rarer ones.  Within a list the sets that meet
are compared by the estimate from the sketch of their union, and what passes is verified on the full sets.

A list of up to ``PAIRED`` sets compares all; in a longer one a set meets its next neighbours and the list's leader, the
set of least id, which joins copies of one text to one group.  Long lists that still hold several groups are then
compared whole, except within a group: the sets outside a list's largest group pass by all of its sets.  Where that is
more than ``WIDE`` comparisons, the list is split by the next values that its sets share, level by level, if the lists
of the next level take fewer comparisons.

Hashes are 64-bit; equal sets are told by 128 bits.  Rows with a null doc_id link with nothing; null and empty texts,
and texts of white space alone, have an empty set and link with nothing.  Repeated rows of a doc_id are copies of one
document and get equal rows.  An empty table gives an empty result.  Columns of other names play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsluice.llm.common import PIECE_BYTES, SLICE_BYTES, Bytes, checkpoint, components, groups_of_rows, lean, mix64, slices, utf8_rows
from docsluice.llm.suffix_dedup import with_ids
from docsluice.llm.vectors import blocks_and_streams

K = 20  # retained values
PERCENT = 80  # similarity from which documents are linked
RISK = 2e-6  # most that a pair at the least similarity may be missed by its sketches
PAIRED, NEXT = 9, 2  # sets of a fully compared list; neighbours met in longer lists
BLOCK = 512  # sets that are held together for exact comparison while others pass by
LIST_PART, CELLS = 16_384, 1 << 20  # sets of a long list that are held together; counters and counts at a time
EARLIER = 16  # lists of a set that are looked through for pairs that have met before
WIDE = 1 << 24  # comparisons of a list from which it is split further
_STEP = np.uint64(0xA0761D6478BD642F)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts that lie one after the other, and the text of each."""
    hashes, rows = [], []
    for first, last in groups_of_rows(bounds):
        at, stop = int(bounds[first]), int(bounds[last])
        while at < stop:
            end = stop
            if last - first == 1 and stop - at > 2 * PIECE_BYTES:  # a long text goes in pieces that end in white space
                gap = np.flatnonzero(_SPACE[raw[at + PIECE_BYTES : min(stop, at + 2 * PIECE_BYTES)]])
                if not len(gap):  # a word that is longer than a piece
                    gap = np.flatnonzero(_SPACE[raw[at + PIECE_BYTES : stop]])
                end = at + PIECE_BYTES + int(gap[0]) if len(gap) else stop
            x = _LOWER[raw[at:end]]
            inside = np.concatenate([[False], ~_SPACE[x], [False]])
            cuts = bounds[first : last + 1] - at
            cuts = cuts[(cuts > 0) & (cuts < len(x))]
            edge = inside[1:] != inside[:-1]
            starts = edge & inside[1:]
            ends = edge & inside[:-1]
            seam = cuts[inside[cuts] & inside[cuts + 1]]  # a text ends and the next begins without white space
            starts[seam] = True
            ends[seam] = True
            a, b = np.flatnonzero(starts), np.flatnonzero(ends)
            hashes.append(Bytes(x).hash(a, b))
            rows.append(np.searchsorted(bounds, a + at, side="right") - 1)
            at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and the bounds of the sets."""
    words, row = word_hashes(raw, bounds)
    n = len(bounds) - 1
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    long = count >= width
    heads = np.repeat(first[long], count[long] - width + 1)
    sizes = count[long] - width + 1
    at = heads + np.arange(len(heads)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = np.zeros(len(at), np.uint64)
    for j in range(width):
        total = total * _STEP + words[at + j]
    owner = np.repeat(np.flatnonzero(long), sizes)
    hashes = [mix64(total)]
    owners = [owner]
    for size in range(1, width):  # fewer words: the whole sequence is the one shingle
        short = np.flatnonzero(count == size)
        total = np.full(len(short), size, np.uint64)
        for j in range(size):
            total = total * _STEP + words[first[short] + j]
        hashes.append(mix64(total ^ _STEP))
        owners.append(short)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(o, minlength=n))])


def _body(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def sketches(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """(doc_id, n, key_a, key_b, kept, brief): size of the set, its 128-bit identity, the k least hashes in order, and
    the upper halves of those as bytes."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=SLICE_BYTES // 4):
                h, edge = shingle_sets(*utf8_rows(batch.column(1)), width)
                size = np.diff(edge)
                some = np.flatnonzero(size)
                keys = [np.zeros(len(size), np.uint64) for _ in range(2)]
                if len(some):
                    for key, salt in zip(keys, (np.uint64(0), _STEP)):
                        key[some] = mix64(np.add.reduceat(mix64(h ^ salt), edge[some]) + size[some].astype(np.uint64))
                kept = np.minimum(size, k)
                spots = np.repeat(edge[:-1], kept) + np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
                offsets = pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(h[spots].view(np.int64)))
                upper, ends = (h[spots] >> np.uint64(32)).astype("<u4"), np.asarray(offsets)
                brief = pa.array([upper[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                columns = [batch.column(0), pa.array(size), *(pa.array(x.view(np.int64)) for x in keys), lists, brief]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "key_a", "key_b", "kept", "brief"])

    return _body(docs).mapInArrow(lean(work), "doc_id long, n long, key_a long, key_b long, kept array<long>, brief binary")


def union_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimates of rows of padded sketches, from the sketch of their union.

    Pads are the two largest values, a different one on each side, so they never agree.
    """
    k = a.shape[1]
    both = np.sort(np.hstack([a, b]), axis=1)
    same = both[:, 1:] == both[:, :-1]
    rank = np.cumsum(np.concatenate([np.ones((len(a), 1), bool), ~same], axis=1), axis=1)  # of each value in the union
    real = both < np.uint64(0xFFFFFFFFFFFFFFFE)
    inside = rank <= k
    hits = (same & inside[:, 1:] & real[:, 1:]).sum(1)
    union = np.minimum(k, np.where(real, rank, 0).max(1))
    return hits / np.maximum(1, union)


def least_shared(percent: int, k: int = K) -> int:
    """How many of k values two sets of that similarity share, but for ``RISK``."""
    p, below, t = percent / 100, 0.0, 0
    while t < k and (below := below + comb(k, t) * p**t * (1 - p) ** (k - t)) <= RISK:
        t += 1
    return max(1, t)


def _padded(column: pa.Array, k: int, pad: int) -> np.ndarray:
    raw, bounds = utf8_rows(column)
    flat, size = raw[bounds[0] : bounds[-1]].copy().view("<u4"), np.diff(bounds) // 4
    out = np.full((len(size), k), np.uint64(pad))
    out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _meet(k: int, percent: int):
    """Pairs (a, b) of the sets in lists that come sorted by (path, part, id)."""
    floor = least_shared(percent, k) / k - 1e-9

    def pairs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v, w, n, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(v)))
        place = np.arange(len(v)) - np.repeat(heads, sizes)
        size = np.repeat(sizes, sizes)
        a, b = [], []
        for step in range(1, PAIRED):
            x = np.flatnonzero((place + step < size) & ((size <= PAIRED) | (step <= NEXT)))
            a.append(x), b.append(x + step)
        x = np.flatnonzero((size > PAIRED) & (place > NEXT))
        a.append(x - place[x]), b.append(x)
        a, b = map(np.concatenate, (a, b))
        fits = np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent
        a, b = a[fits], b[fits]
        left, right = _padded(batch.column(4), k, 2**64 - 1), _padded(batch.column(4), k, 2**64 - 2)
        for at in range(0, len(a), 50_000):
            i, j = a[at : at + 50_000], b[at : at + 50_000]
            good = union_estimate(left[i], right[j]) >= floor
            yield pa.RecordBatch.from_arrays([pa.array(ids[i[good]]), pa.array(ids[j[good]])], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            v, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(v):
                continue
            open_ = int(np.flatnonzero((v != v[-1]) | (w != w[-1]))[-1]) + 1 if ((v != v[-1]) | (w != w[-1])).any() else 0
            if open_ == 0 and len(v) > 10_000:  # a hot list: settle what is there, keep its leader and its last sets
                yield from pairs(batch)
                held = pa.Table.from_batches([batch.slice(0, 1), batch.slice(len(v) - PAIRED)]).combine_chunks().to_batches()[0]
                continue
            if open_:
                yield from pairs(batch.slice(0, open_))
            held = batch.slice(open_)
        if held is not None and held.num_rows:
            yield from pairs(held)

    return work


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, h): the whole sorted set of each of some documents, as bytes."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                h, edge = shingle_sets(*utf8_rows(batch.column(1)), width)
                lists = pa.array([h[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "h"])

    return with_ids(_body(docs), ids).mapInArrow(sets, "doc_id long, h binary")


def confirm(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) with the exact sizes of intersection (``both``) and union (``any``) of their sets."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct()
    full = full_sets(docs, ids, width)
    left, right = full.select(F.col("doc_id").alias("a"), F.col("h").alias("ha")), full.select(F.col("doc_id").alias("b"), F.col("h").alias("hb"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ra, ea), (rb, eb) = utf8_rows(batch.column(2)), utf8_rows(batch.column(3))
            both, any_ = [], []
            for i in range(batch.num_rows):
                x, y = ra[ea[i] : ea[i + 1]].view(np.uint64), rb[eb[i] : eb[i + 1]].view(np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                n = int((y[at] == x).sum())
                both.append(n), any_.append(len(x) + len(y) - n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(both, pa.int64()), pa.array(any_, pa.int64())], ["a", "b", "both", "any"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb")
    return joined.mapInArrow(count, "a long, b long, both long, any long")


def by_rarity(sets: DataFrame, percent: int = PERCENT, k: int = K) -> DataFrame:
    """(id, n, brief, vals, reach) of the sets that may have a partner: the retained values that other sets retain too,
    rarest first.  Level j of the lists takes the first ``reach`` + j of them."""
    values = sets.select("id", F.size("kept").alias("size"), F.explode("kept").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    ordered = values.join(shared, "v").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("s"))
    least = F.least(F.lit(least_shared(percent, k)), F.ceil(F.col("size") * percent / 100)).cast("int")
    ordered = ordered.where(F.size("s") >= least).select("id", F.col("s.v").alias("vals"), (F.size("s") - least).alias("reach"))
    return sets.select("id", "n", "brief").join(ordered, "id")


def first_lists(ordered: DataFrame) -> DataFrame:
    """(path, pos, id): each set under its rarest values."""
    return ordered.select("id", F.posexplode(F.slice("vals", F.lit(1), F.col("reach") + 1)).alias("pos", "path")).select("path", "pos", "id")


def linked_sets(docs: DataFrame, sets: DataFrame, width: int, percent: int = PERCENT, k: int = K) -> DataFrame:
    """(a, b) links between the representatives of distinct sets (id, n, kept, brief) that join every linked group.

    Links within a group that is already joined are not verified: first every set's pair with the least id, then the
    pairs whose ends are still apart, then long lists across groups.
    """
    ordered = checkpoint(by_rarity(sets, percent, k))
    lists = first_lists(ordered)
    sizes = checkpoint(lists.groupBy("path").agg(F.count("*").alias("m"), F.min("id").alias("lo")).where("m > 1"))
    # A long list is dealt to several tasks; its leader is in each.
    parts = F.ceil(F.col("m") / LIST_PART)
    own = F.when(F.col("id") == F.col("lo"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), parts)))
    rows = lists.join(sizes, "path").select("path", "id", F.explode(own).alias("part")).join(ordered.select("id", "n", "brief"), "id")
    dealt = rows.select("path", "part", "n", "id", "brief").repartition("path", "part").sortWithinPartitions("path", "part", "id")
    pairs = checkpoint(dealt.mapInArrow(_meet(k, percent), "a long, b long").distinct())
    linked = F.col("both") * 100 >= F.col("any") * percent

    # Ids of a pair are in order, so a set's pair with the least id is the minimum of its ``a``.
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    edges = checkpoint(confirm(first, docs, width).where(linked).select("a", "b"))
    apart = checkpoint(_apart(pairs, edges).join(first, ["a", "b"], "left_anti"))
    edges = checkpoint(confirm(apart, docs, width).where(linked).select("a", "b").unionAll(edges))

    home = ordered.join(components(edges).withColumnRenamed("node", "id"), "id", "left").join(first.withColumnsRenamed({"b": "id", "a": "home"}), "id", "left")
    home = checkpoint(home.withColumn("group", F.coalesce("component", "id")).withColumn("home", F.coalesce("home", "id")).drop("component"))
    long = lists.join(sizes.where(F.col("m") > PAIRED).select("path"), "path").join(home.select("id", "group"), "id")
    found = None
    for rows, tallies in open_lists(long, home, least_shared(percent, k)):
        part = list_pairs(rows, tallies, home, percent, k)
        found = part if found is None else found.unionAll(part)
    return edges if found is None else edges.unionAll(_in_blocks(checkpoint(found.distinct()), docs, width, percent))


def _tally(rows: DataFrame, *keys: str) -> DataFrame:
    """Per list that holds several groups: its sets, its largest group, and the comparisons that it takes."""
    of_group = rows.groupBy(*keys, "group").agg(F.count("*").alias("c"))
    lists = of_group.groupBy(*keys).agg(F.sum("c").alias("m"), F.max(F.struct("c", "group")).alias("top"))
    cost = (F.col("m") - F.col("top.c")).cast("double") * F.col("m")
    return lists.where("m > top.c").select(*keys, "m", F.col("top.group").alias("top"), cost.alias("cost"))


def open_lists(rows: DataFrame, home: DataFrame, levels: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Rows (path, pos, id, group) and tallies of the lists to be compared whole, level by level.

    The lists of a level are compared but for those that are wide and whose split takes fewer comparisons.
    """
    tallies = checkpoint(_tally(rows, "path"))
    for level in range(1, levels + 1):
        if tallies.isEmpty():
            return
        wide = tallies.where(F.col("cost") > WIDE)
        if level == levels or wide.isEmpty():
            yield rows, tallies
            return
        parents = wide.select(F.col("path").alias("parent"), F.col("cost").alias("before"))
        behind = F.expr(f"filter(transform(vals, (v, i) -> struct(v, i)), x -> x.i > pos and x.i <= reach + {level})")
        below = (
            rows.withColumnRenamed("path", "parent").join(parents.select("parent"), "parent").join(home.select("id", "vals", "reach"), "id")
            .select("parent", "id", "group", F.explode(behind).alias("x"))
            .select("parent", F.xxhash64("parent", "x.v").alias("path"), F.col("x.i").alias("pos"), "id", "group")
        )
        below = checkpoint(below)
        inner = checkpoint(_tally(below, "parent", "path"))
        after = inner.groupBy("parent").agg(F.sum("cost").alias("after"))
        split = checkpoint(parents.join(after, "parent", "left").where("coalesce(after, 0) < before").select("parent"))
        yield rows, tallies.join(split.withColumnRenamed("parent", "path"), "path", "left_anti")
        rows = below.join(split, "parent", "left_semi").select("path", "pos", "id", "group")
        tallies = inner.join(split, "parent", "left_semi").drop("parent")


def list_pairs(rows: DataFrame, tallies: DataFrame, home: DataFrame, percent: int, k: int) -> DataFrame:
    """(a, flag, id): candidates across the groups of lists, as sets to be held at block ``a`` (flag 0), the sets that
    share their least partner, and sets that pass by there (flag 1).

    Two sets that share several of these lists meet in the first of them alone: each row knows its set's earlier lists.
    """
    body = rows.select("path", "id").join(tallies.select("path", "top", F.ceil(F.col("m") / LIST_PART).alias("parts")), "path")
    own = F.sort_array(F.collect_list("path").over(Window.partitionBy("id")))
    # Of many earlier lists some are enough: a pair that is not known from an earlier one is only compared once more.
    body = body.withColumn("own", own).withColumn("earlier", F.slice(F.filter("own", lambda x: x < F.col("path")), 1, EARLIER)).drop("own")
    body = body.join(home.select("id", "n", "brief", "group", "home"), "id")
    columns = ["id", "n", "group", "home", "brief", "top", "earlier"]
    held = body.select("path", F.pmod(F.xxhash64("id"), "parts").alias("part"), F.lit(0).alias("flag"), *columns)
    passing = body.where(F.col("group") != F.col("top"))
    passing = passing.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("flag"), *columns)
    dealt = held.unionAll(passing).repartition("path", "part").sortWithinPartitions("path", "part", "flag")
    return dealt.mapInArrow(blocks_and_streams(2, _list_pairs(k, percent)), "a long, flag int, id long")


class _Holders:
    """Which rows of a block hold a value."""

    def __init__(self, values: np.ndarray, row: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.row = row[order]
        self.known, self.start = np.unique(values[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(order)))

    def known_of(self, values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the values that the block holds, and their rows."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
        hit = self.known[at] == values
        return at[hit], row[hit]

    def shared(self, at: np.ndarray, row: np.ndarray, rows: int, m: int) -> np.ndarray:
        """How many values each of ``rows`` rows shares with each of the block's ``m``, row by row."""
        c = self.count[at]
        spots = np.repeat(self.start[at] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        return np.bincount(np.repeat(row, c) * m + self.row[spots], minlength=rows * m)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the row of each."""
    sizes = np.diff(np.asarray(column.offsets))
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _list_pairs(k: int, percent: int):
    """The candidates of a part of a list."""
    floor = least_shared(percent, k) / k - 1e-9

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6, 8)]

    def work(key: tuple, block: list[pa.RecordBatch], stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not block:
            return
        ids, n, group, home, largest = map(np.concatenate, zip(*map(columns, block)))
        right = np.concatenate([_padded(b.column(7), k, 2**64 - 2) for b in block])
        m, real = len(ids), right < np.uint64(1 << 32)
        kept = real.sum(1)
        values = _Holders(right[real], np.repeat(np.arange(m), kept))
        met = _Holders(*_flat(pa.chunked_array([b.column(9) for b in block]).combine_chunks()))
        told = np.zeros(m, bool)
        for batch in stream:
            fields, sketch = columns(batch), _padded(batch.column(7), k, 2**64 - 1)
            mine = sketch < np.uint64(1 << 32)
            size = mine.sum(1)
            found = values.known_of(sketch[mine], np.repeat(np.arange(len(size)), size))
            before = met.known_of(*_flat(batch.column(9)))
            # Rows go in groups by their cells and by what is counted into them: sets that are alike share most values.
            weight = np.full(len(size), max(m, k * k))
            for index, (at, row) in ((values, found), (met, before)):
                weight += np.bincount(row, weights=index.count[at], minlength=len(size)).astype(np.int64)
            for top, stop in groups_of_rows(np.concatenate([[0], np.cumsum(weight)]), CELLS):
                xi, xn, xg, _, _ = (f[top:stop] for f in fields)
                left = sketch[top:stop]
                both, again = (
                    index.shared(at[a:b], row[a:b] - top, stop - top, m)
                    for index, (at, row) in ((values, found), (met, before)) for a, b in [np.searchsorted(row, [top, stop])]
                )
                # The union's sketch has at least as many values as the larger of the two.
                i, j = np.divmod(np.flatnonzero((both > 0) & (again == 0)), m)
                low, high = np.minimum(xn[i], n[j]), np.maximum(xn[i], n[j])
                least = floor * np.maximum(size[top + i], kept[j]) - 1e-9
                once = (xi[i] < ids[j]) | (group[j] == largest[j])  # the largest group does not pass by
                good = once & (xg[i] != group[j]) & (low * 100 >= high * percent) & (both[i * m + j] >= least)
                i, j = i[good], j[good]
                out = []
                for part in range(0, len(i), 50_000):
                    x, y = i[part : part + 50_000], j[part : part + 50_000]
                    good = union_estimate(left[x], right[y]) >= floor
                    x, y = x[good], y[good]
                    new = np.unique(y[~told[y]])  # a set is held once, whoever passes by
                    told[new] = True
                    out += [np.stack([home[new], np.zeros(len(new), np.int64), ids[new]], 1), np.stack([home[y], np.ones(len(x), np.int64), xi[x]], 1)]
                if out:
                    a, flag, who = np.unique(np.concatenate(out), axis=0).T
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(flag.astype(np.int32)), pa.array(who)], ["a", "flag", "id"])

    return work


def _in_blocks(found: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) links of the sets held at a block with the sets that pass by there."""
    parts = found.where("flag = 0").groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    own = F.when(F.col("flag") == 0, F.array(F.pmod(F.xxhash64("id"), "parts").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = checkpoint(found.join(parts, "a").select("a", F.explode(own).alias("part"), "flag", "id"))
    full = full_sets(docs, rows.select(F.col("id").alias("doc_id")).distinct(), width).withColumnRenamed("doc_id", "id")

    def values(batch: pa.RecordBatch) -> list[np.ndarray]:
        raw, edge = utf8_rows(batch.column(4))
        return [raw[a:b].view(np.uint64) for a, b in zip(edge[:-1], edge[1:])]

    def meet(key: tuple, block: list[pa.RecordBatch], stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not block:
            return
        own = [v.copy() for batch in block for v in values(batch)]
        ids = np.concatenate([b.column(3).to_numpy(zero_copy_only=False) for b in block])
        size = np.array([len(v) for v in own])
        flat = np.concatenate(own)
        order = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(own)), size)[order]
        known, first = np.unique(flat[order], return_index=True)
        count = np.diff(np.append(first, len(flat)))
        for batch in stream:
            found = []
            for y, v in zip(batch.column(3).to_pylist(), values(batch)):
                at = np.minimum(np.searchsorted(known, v), len(known) - 1)
                at = at[known[at] == v]
                n = count[at]
                spots = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.bincount(owner[spots], minlength=len(own))
                good = (both * 100 >= percent * (size + len(v) - both)) & (ids != y)
                found += [(min(x, y), max(x, y)) for x in ids[good].tolist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    joined = rows.join(full, "id").select("a", "part", "flag", "id", "h").repartition("a", "part").sortWithinPartitions("a", "part", "flag")
    return joined.mapInArrow(blocks_and_streams(2, meet), "a long, b long").distinct()


def _apart(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs whose ends the edges do not join."""
    group = components(edges)
    a, b = group.select(F.col("node").alias("a"), F.col("component").alias("ca")), group.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    sides = pairs.join(a, "a", "left").join(b, "b", "left")
    return sides.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document: sets of ``width``-word shingles, similarity in percent."""
    known = docs.where("doc_id is not null").select("doc_id", "text")
    drawn = checkpoint(sketches(known, width))
    sets = drawn.where("n > 0").groupBy("key_a", "key_b").agg(F.min(F.struct("doc_id", "n", "kept", "brief")).alias("r"))
    sets = checkpoint(sets.select("key_a", "key_b", F.col("r.doc_id").alias("id"), "r.n", "r.kept", "r.brief"))
    reached = components(linked_sets(known, sets.select("id", "n", "kept", "brief"), width, percent))
    group = sets.join(reached.withColumnRenamed("node", "id"), "id", "left").select("key_a", "key_b", F.coalesce("component", "id").alias("group"))
    of_document = drawn.select("doc_id", "n", "key_a", "key_b").join(group, ["key_a", "key_b"], "left")
    linked = of_document.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("group")).otherwise(F.col("doc_id")).alias("component_id"))
    alone = sketches(docs.where("doc_id is null"), width).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with all its columns; repeated rows of a doc_id are one document, null ids stay."""
    gone = checkpoint(near_duplicates(docs, width, percent).where(~F.col("kept")).select("doc_id").distinct())
    stay = with_ids(docs.where("doc_id is not null"), gone, "left_anti")
    # Only rows of a repeated doc_id are shuffled to keep one of each.
    again = checkpoint(stay.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    return with_ids(stay, again, "left_anti").unionByName(with_ids(stay, again).dropDuplicates(["doc_id"])).unionByName(docs.where("doc_id is null"))
