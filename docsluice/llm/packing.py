"""Packing token sequences by length patterns fitted with non-negative least squares.

Documents are tokenized and cut into pieces of at most ``size`` tokens.  Only the histogram of piece lengths (at most
``size`` numbers) is packed: patterns of few pieces that fill a sequence are enumerated, their repeat counts are fitted
to the histogram by non-negative least squares and rounded down, and what is left is packed best-fit by length.  The
result is a table of runs (length, ranks from-to, first sequence, offset), and every piece finds its run by its rank
among the pieces of its length.  Ranks are counted per part of the input and then over parts, so a length that holds
most pieces is not ranked in one task.

A null text is empty; an empty text is one piece that holds the closing id alone.  Repeated rows are packed as often as
they occur.  An empty table gives an empty result.  Columns other than doc_id and text play no part.
"""

from __future__ import annotations

import bisect
import gc
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docsluice.llm.bpe import WORD_END, Memo, plain_words
from docsluice.llm.common import SLICE_BYTES, checkpoint, give_back, slices, texts

SIZE = 4096  # tokens in a sequence
CLOSE_ID = 1  # closes every document
KNOWN_CHUNKS, FEW_CHUNKS = 700_000, 100_000  # remembered chunks in each of a worker's two generations, alone and among other jobs
GRID = 64  # lengths of patterns are fitted on this many steps; rounding down of counts keeps them feasible


class LibraryIds:
    """Ids of whole texts by the tokenizers library; words and chunks between white space are remembered by the worker.

    White space separates words in this vocabulary and is dropped, so the ids of a text are those of its chunks, and
    those of a chunk are those of its words.
    """

    def __init__(self, path: str, known: int = KNOWN_CHUNKS):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.words = Memo(lambda word: self._ids([word])[0], known // 2)
        self.memo = Memo(lambda chunk: self._learn({chunk})[chunk], known)

    def _one(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of words: they go to the library as one text, which is cut where tokens end words."""
        ids = self._one(" ".join(words))
        cuts = (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1) * 4
        if len(cuts) != len(words) or (len(cuts) and cuts[-1] != len(ids)):
            return [self._one(w) for w in words]
        cuts = cuts.tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks seen for the first time; their new words go to the library together."""
        words_of = {c: None if "<|" in c else plain_words(c) for c in chunks}
        todo = list({w for words in words_of.values() if words for w in words if self.words.look(w) is None})
        for i in range(0, len(todo), 4096):
            for word, ids in zip(todo[i : i + 4096], self._ids(todo[i : i + 4096])):
                self.words.put(word, ids)
        out = {}
        for chunk, words in words_of.items():
            if words is None:
                out[chunk] = self._one(chunk)
            else:
                out[chunk] = self.words[words[0]] if len(words) == 1 else b"".join([self.words[w] for w in words])
            if len(chunk) <= 64:
                self.memo.put(chunk, out[chunk])
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 32-bit ids of texts one after the other, and where each text's begin and the last one's end.

        Texts are split at ASCII white space; of a batch every distinct chunk is looked up once.
        """
        chunks = pc.ascii_split_whitespace(column)
        edges = np.asarray(chunks.offsets) - (chunks.offsets[0].as_py() if len(chunks.offsets) else 0)
        coded = chunks.flatten().dictionary_encode()
        distinct, which = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        del chunks
        get, look = self.memo.get, self.memo.look
        known = [get(c) or look(c) for c in distinct]
        new = {c for c, ids in zip(distinct, known) if ids is None}
        if new:
            learned = self._learn(new)
            known = [learned[c] if ids is None else ids for c, ids in zip(distinct, known)]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool, start = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[which]
        ends = np.cumsum(n)
        spots = np.repeat(start[which] - (ends - n), n)
        spots += np.arange(len(spots))
        ids = pool[spots]
        return ids, np.concatenate([[0], ends])[edges]


@lru_cache(maxsize=2)
def library_ids(path: str, known: int = KNOWN_CHUNKS) -> LibraryIds:
    gc.set_threshold(100_000, 50, 100)  # else the collector keeps walking the tables, which hold nothing it could free
    return LibraryIds(path, known)


def pieces(docs: DataFrame, vocabulary_path: str, size: int = SIZE, with_ids: bool = False, keep_tables: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth[, ids]): pieces of tokenized documents.

    ``nth`` counts the pieces of one length within one part (a task's rows) of the input.  Known chunks are kept for the
    worker's next task unless ``keep_tables`` is off: then a worker that other jobs have used, and will use, remembers
    fewer, takes less text at a time, gives back what that leaves, and leaves their memory to whatever runs after.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *(["ids"] if with_ids else [])]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
    close = np.array([CLOSE_ID], "<u4")
    known, limit = (KNOWN_CHUNKS, 4 * SLICE_BYTES) if keep_tables else (FEW_CHUNKS, SLICE_BYTES // 4)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep_tables:
            give_back()  # what earlier stages left
        coder, part, seen = library_ids(vocabulary_path, known), TaskContext.get().partitionId(), defaultdict(int)
        for batch in (some for whole in batches for some in slices(whole, limit=limit)):
            ids, edges = coder.encode(batch.column(1))
            rows = []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), edges[:-1].tolist(), edges[1:].tolist()):
                own = np.concatenate([ids[a:b], close])
                for piece, at in enumerate(range(0, len(own), size)):
                    cut = own[at : at + size]
                    n = len(cut)
                    rows.append((doc_id, piece, at, n, zlib.crc32(cut.tobytes()), part, seen[n], *([cut.view("<i4")] if with_ids else [])))
                    seen[n] += 1
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names)
            if not keep_tables:
                give_back()
        if not keep_tables:
            library_ids.cache_clear()
            del coder
            gc.collect()  # its tables and their functions know each other
            give_back()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return texts(docs).mapInArrow(work, schema + (", ids array<int>" if with_ids else ""))


def patterns(lengths: np.ndarray, size: int, grid: int = GRID) -> list[tuple[int, ...]]:
    """Descending tuples of at most four grid steps that fill a sequence, over the steps that occur."""
    steps = sorted({int(-(-n * grid // size)) for n in lengths})
    have, out = set(steps), []
    for a in steps[::-1]:
        if a == grid:
            out.append((a,))
        for b in (s for s in steps if s <= min(a, grid - a)):
            if a + b == grid:
                out.append((a, b))
            for c in (s for s in steps if s <= min(b, grid - a - b)):
                d = grid - a - b - c
                if d == 0:
                    out.append((a, b, c))
                elif d in have and d <= c:
                    out.append((a, b, c, d))
    return out


def fit(wanted: np.ndarray, rows: list[tuple[int, ...]], rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts of patterns whose weighted squared gap to the wanted step counts is least.

    Accelerated projected gradient; longer pieces weigh more, as gaps there cost more sequences.
    """
    if not rows:
        return np.zeros(0)
    n, width = len(wanted), max(map(len, rows))
    index = np.array([[*r, *[0] * (width - len(r))] for r in rows])  # step 0 is a blank
    weight = np.sqrt(np.arange(n, dtype=float) / n)

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for j in range(width):
            out += np.bincount(index[:, j], weights=x, minlength=n)
        out[0] = 0
        return out * weight

    def backward(y: np.ndarray) -> np.ndarray:
        y = y * weight
        y[0] = 0
        return y[index].sum(axis=1)

    x = np.ones(len(rows))
    for _ in range(20):
        y = backward(forward(x))
        top = np.linalg.norm(y)
        x = y / top
    step, target = 1 / (1.05 * top), wanted * weight
    x = z = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, z - step * backward(forward(z) - target))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = nxt + (t - 1) / t_next * (nxt - x)
        x, t = nxt, t_next
    return x


def plan(histogram: dict[int, int], size: int = SIZE, grid: int = GRID) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece of a length histogram.

    Pieces of a run go to consecutive sequences, all at the run's offset.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if not left:
        return []
    runs: list[tuple[int, int, int, int, int]] = []
    rank: dict[int, int] = defaultdict(int)
    sequence = 0

    def place(combo: list[int], times: int) -> None:
        """``times`` sequences of these pieces; a length may occur more than once."""
        nonlocal sequence
        offset = 0
        for n in combo:
            runs.append((n, rank[n], times, sequence, offset))
            rank[n] += times
            left[n] -= times
            if not left[n]:
                del left[n]
                order.remove(n)
            offset += n
        sequence += times

    # 1. Patterns on the grid, fitted and rounded down; a step stands for the lengths that round up to it.
    lengths = np.array(sorted(left))
    by_step: dict[int, list[int]] = defaultdict(list)
    for n in lengths:
        by_step[int(-(-n * grid // size))].append(int(n))
    wanted = np.zeros(grid + 1)
    for s, ns in by_step.items():
        wanted[s] = sum(left[n] for n in ns)
    rows = patterns(lengths, size, grid)
    order = sorted(left)

    def largest(room: int, need: dict[int, int]) -> int | None:
        """The longest piece left that fits a room."""
        at = bisect.bisect_right(order, room) - 1
        while at >= 0 and left[order[at]] <= need[order[at]]:
            at -= 1
        return order[at] if at >= 0 else None

    for row, count in sorted(zip(rows, np.floor(fit(wanted, rows)).astype(int)), key=lambda x: (-x[1], x[0])):
        while count > 0:
            combo: list[int] = []
            need: dict[int, int] = defaultdict(int)
            for s in row[:-1]:
                by_step[s] = [n for n in by_step[s] if n in left]
                choice = next((n for n in reversed(by_step[s]) if left[n] > need[n]), None)
                if choice is None:
                    break
                combo.append(choice)
                need[choice] += 1
            if len(combo) < len(row) - 1:
                break
            # The last piece is the longest that fits: a step stands for lengths up to it, so the room may be wider.
            while (choice := largest(size - sum(combo), need)) is not None:
                combo.append(choice)
                need[choice] += 1
            if len(combo) < len(row):
                break
            times = min(count, *(left[n] // k for n, k in need.items()))
            place(combo, times)
            count -= times

    # 2. The residual, best fit by length: the longest piece, then the longest that still fits, as often as counts allow.
    while left:
        combo, need = [], defaultdict(int)
        while (choice := largest(size - sum(combo), need)) is not None:
            combo.append(choice)
            need[choice] += 1
        place(combo, min(left[n] // k for n, k in need.items()))
    return runs


def pack(docs: DataFrame, vocabulary_path: str, size: int = SIZE, with_ids: bool = False, keep_tables: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): every piece with its place."""
    spark = docs.sparkSession
    cut = checkpoint(pieces(docs, vocabulary_path, size, with_ids, keep_tables))
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    runs = plan(totals, size)
    if not runs:
        return cut.drop("part", "nth").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    # First rank of a length in a part: a running sum over parts, in blocks of parts so that it is never one long window.
    start = _starts(counts)
    ranked = cut.join(start, ["length", "part"]).withColumn("rank", F.col("first") + F.col("nth"))
    # A run is found by searching the run starts of the length; the table of runs is bounded by the patterns used.
    by_length: dict[int, list] = defaultdict(list)
    for n, first, _, sequence, offset in runs:
        by_length[n].append((first, sequence, offset))
    shared = spark.sparkContext.broadcast({n: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(v))) for n, v in by_length.items()})

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((2, len(length)), dtype=np.int64)
        n, r = length.to_numpy(), rank.to_numpy()
        for value in np.unique(n):
            mine = n == value
            first, sequence, offset = shared.value[int(value)]
            at = np.searchsorted(first, r[mine], side="right") - 1
            out[0, mine], out[1, mine] = sequence[at] + r[mine] - first[at], offset[at]
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    placed = ranked.withColumn("at", place("length", "rank"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset")]
    return placed.select(*kept, *(["ids"] if with_ids else []))


def _starts(counts: DataFrame, block: int = 1024) -> DataFrame:
    """(length, part, first): how many pieces of a length stand in earlier parts."""
    from pyspark.sql import Window

    earlier = (Window.unboundedPreceding, -1)
    split = counts.withColumn("block", (F.col("part") / block).cast("int"))
    inner = Window.partitionBy("length", "block").orderBy("part").rowsBetween(*earlier)
    outer = Window.partitionBy("length").orderBy("block").rowsBetween(*earlier)
    blocks = split.groupBy("length", "block").agg(F.sum("n").alias("n")).select("length", "block", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    return split.join(blocks, ["length", "block"]).select(
        "length", "part", (F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("first")
    )

