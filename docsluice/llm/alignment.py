"""Tokens of two vocabularies aligned by their bytes: groups by pointer jumping, links counted over the corpus.

A text is encoded twice: with a space in front by a byte-level BPE vocabulary (A), and by a piece vocabulary (B), which
adds that space itself.  Both token sequences spell the same bytes.  Every token points to its farthest-right
overlapping token; doubling the pointers of all tokens at once, until nothing changes, leads each token to the last
token of its connected component.  Components are the groups between places where tokens of A and of B both end.
Two tokens are linked when their byte ranges overlap; a pair of ids counts in how many documents it is linked.

Tasks number the pairs of a block of documents (``BLOCK_BYTES`` of text) once.  Only a block's distinct pairs are
counted and joined with the corpus-wide counts, and they meet the block's documents in one task of bounded size.

A null or empty text, and one that a vocabulary does not spell byte for byte, has no tokens: zeros and ''.  Rows with
a null doc_id are documents too, and repeated rows are documents of their own.  An empty table gives an empty result.
Long texts are encoded in pieces cut before a single space, where tokens of both vocabularies end.  Columns other than
doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from docsluice.llm.bpe import byte_letters
from docsluice.llm.common import slices, texts, written
from docsluice.llm.vectors import blocks_and_streams

BLOCK_BYTES = 16 << 20  # text of a block of documents
PIECE_CHARS = 1 << 16  # longer texts are encoded in pieces of about so many characters
SPACE = "▁"  # fixed value: the space mark of piece vocabularies
# Fixed value: the splitting pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S) (?=[^\W\d_])")


def cut(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Pieces of a text between single spaces that stand before a letter and behind no white space."""
    out, at = [], 0
    while len(text) - at > size:
        place = _CUT.search(text, at + size)
        if place is None:
            break
        out.append(text[at : place.start()])
        at = place.end()
    out.append(text[at:])
    return out


class ByteVocabulary:
    """A byte-level BPE file: encoded with its ids as merge ranks where they are, else by the file's own library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = {c: b for b, c in enumerate(byte_letters())}
        self.size = max(model["vocab"].values()) + 1
        self.bytes = [b""] * self.size
        for token, i in model["vocab"].items():
            if all(c in letter for c in token):
                self.bytes[i] = bytes(letter[c] for c in token)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        self.fast = None
        if made == list(range(256, 256 + len(made))):
            ranks = {self.bytes[i]: i for i in range(256 + len(made))}
            self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode_ordinary(text)
            except (KeyboardInterrupt, SystemExit):
                raise
            except BaseException:  # noqa: BLE001  its pattern engine gives up on very long runs of white space
                pass
        return self.library.encode(text, add_special_tokens=False).ids


class PieceVocabulary:
    """A piece file; its library puts a space in front of a text."""

    def __init__(self, path: str):
        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode("utf-8") for i, p in enumerate(pieces)
        ]
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in pieces)  # no piece reaches over a cut


class Aligned(NamedTuple):
    """Tokens of some texts that both vocabularies spell, one text after the other."""

    rows: np.ndarray  # which texts
    a: np.ndarray  # ids
    b: np.ndarray
    a_rows: np.ndarray  # where a text's tokens begin, and the end
    b_rows: np.ndarray
    a_end: np.ndarray  # bytes before a token's end
    b_end: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    first_group: np.ndarray  # where a text's groups begin, and the end


def last_tokens(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """For every token of A and then of B, the token of B that ends its component, by pointer jumping."""
    n = len(a_end)
    over_a = np.searchsorted(a_end, b_end)  # the token of A over the last byte of a token of B
    here = n + np.arange(len(b_end))
    succ = np.concatenate([n + np.searchsorted(b_end, a_end), np.where(a_end[over_a] > b_end, over_a, here) if n else here])
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            return succ - n
        succ = further


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteVocabulary(byte_path), PieceVocabulary(piece_path)
        self.a_len = np.array([len(x) for x in self.a.bytes])
        self.b_len = np.array([len(x) for x in self.b.bytes])
        top = max(self.a.size, self.b.size)
        self.width = len(str(top)) + 1  # digits and a separator
        self.digits = np.zeros((top, self.width), np.uint8)
        names = [str(i).encode() for i in range(top)]
        for i, name in enumerate(names):
            self.digits[i, : len(name)] = list(name)
        self.n_digits = np.array([len(x) for x in names])

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both vocabularies, or None where one of them does not spell the text."""
        parts = cut(text) if self.b.splits else [text]
        a = [i for p in parts for i in self.a.encode(" " + p)]
        b = [i for ids in self.b.model.encode(parts, num_threads=1) for i in ids]
        whole = b" " + text.encode("utf-8")
        if b"".join(map(self.a.bytes.__getitem__, a)) != whole or b"".join(map(self.b.bytes.__getitem__, b)) != whole:
            return None
        return a, b

    def align(self, batch: list[str]) -> Aligned:
        rows, a, b, a_rows, b_rows = [], [], [], [0], [0]
        for row, text in enumerate(batch):
            ids = self.encode(text) if text else None
            if ids is not None:
                rows.append(row)
                a.append(np.array(ids[0], np.int64))
                b.append(np.array(ids[1], np.int64))
                a_rows.append(a_rows[-1] + len(a[-1]))
                b_rows.append(b_rows[-1] + len(b[-1]))
        none = [np.zeros(0, np.int64)]
        a, b = np.concatenate(a or none), np.concatenate(b or none)
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        last = last_tokens(a_end, b_end)
        closing = np.zeros(len(b), np.int64)
        closing[last] = 1
        number = np.cumsum(closing) - 1
        group = number[last]
        firsts = np.concatenate([[0], np.cumsum(closing)])[np.array(b_rows)]
        return Aligned(np.array(rows, np.int64), a, b, np.array(a_rows), np.array(b_rows), a_end, b_end, group[: len(a)], group[len(a) :], firsts)

    def links(self, t: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of ``rows``, token of A, token of B) of all links: one for each stretch between two ends."""
        ends = np.sort(np.concatenate([t.a_end, t.b_end]), kind="stable")  # two sorted runs
        ends = ends[np.diff(ends, prepend=-1) > 0]
        row = np.searchsorted(t.a_end[t.a_rows[1:] - 1], ends) if len(t.rows) else ends
        return row, np.searchsorted(t.a_end, ends), np.searchsorted(t.b_end, ends)

    def spell_groups(self, t: Aligned) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each of ``rows``."""
        if not len(t.rows):
            return []
        groups = int(t.first_group[-1])
        many_a, many_b = np.bincount(t.a_group, minlength=groups), np.bincount(t.b_group, minlength=groups)
        upto_a, upto_b = np.cumsum(many_a), np.cumsum(many_b)
        ids = np.empty(len(t.a) + len(t.b), np.int64)
        ids[np.arange(len(t.a)) + (upto_b - many_b)[t.a_group]] = t.a
        ids[np.arange(len(t.b)) + upto_a[t.b_group]] = t.b
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[upto_a + upto_b - many_b - 1] = ord("|")
        mark[upto_a + upto_b - 1] = ord(";")
        letters, n = self.digits[ids], self.n_digits[ids]
        letters[np.arange(len(ids)), n] = mark
        flat = letters[np.arange(self.width) <= n[:, None]]
        stop = np.concatenate([[0], np.cumsum(n + 1)])[t.a_rows + t.b_rows]
        return [flat[i : j - 1].tobytes() for i, j in zip(stop[:-1], stop[1:])]


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def pack(index: np.ndarray, times: np.ndarray) -> bytes:
    """Rising indexes and repeats as compressed byte planes of their steps and numbers."""
    both = np.stack([np.diff(index, prepend=0), times]).astype("<u4")
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").reshape(2, -1).astype(np.int64)
    return np.cumsum(both[0]), both[1]


_ENCODED = "block long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pos int, pair long, held long"
_ARROW = pa.schema([
    ("block", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()), ("pos", pa.int32()), ("pair", pa.int64()), ("held", pa.int64()),
])


class _Block:
    """Documents of a block until their pairs are numbered: the most frequent first, so that numbers are small."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.docs: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.many: list[int] = []  # distinct pairs of each document

    def add(self, model: Aligner, ids: list, batch: list[str], n_bytes: int) -> None:
        t = model.align(batch)
        row, at_a, at_b = model.links(t)
        span = model.a.size * model.b.size
        keys, times = np.unique(row * span + t.a[at_a] * model.b.size + t.b[at_b], return_counts=True)
        n = np.bincount(keys // span, minlength=len(t.rows)) if len(t.rows) else []
        links = np.bincount(row, minlength=len(t.rows)) if len(t.rows) else []
        facts = [(0, 0, 0, 0, "")] * len(ids)
        many = [0] * len(ids)
        for k, (r, spelled) in enumerate(zip(t.rows.tolist(), model.spell_groups(t))):
            facts[r] = (int(t.a_rows[k + 1] - t.a_rows[k]), int(t.b_rows[k + 1] - t.b_rows[k]), int(t.first_group[k + 1] - t.first_group[k]),
                        int(links[k]), hashlib.sha256(spelled).hexdigest())
            many[r] = int(n[k])
        self.docs += [(i, *f) for i, f in zip(ids, facts)]
        self.many += many
        self.pairs.append(keys % span)
        self.times.append(times)
        self.bytes += n_bytes

    def rows(self) -> Iterator[pa.RecordBatch]:
        pairs, index, held = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        order = np.argsort(-held, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        index, times = place[index], np.concatenate(self.times)
        stop = np.concatenate([[0], np.cumsum(self.many)]).astype(int)
        packed = []
        for i, j in zip(stop[:-1], stop[1:]):
            by = np.argsort(index[i:j])
            packed.append(pack(index[i:j][by], times[i:j][by]))
        yield self._batch(1, len(self.docs), links=packed, **dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), map(list, zip(*self.docs)))))
        yield self._batch(0, len(pairs), pos=np.arange(len(pairs), dtype=np.int32), pair=pairs[order], held=held[order])

    def _batch(self, kind: int, n: int, **columns) -> pa.RecordBatch:
        columns |= {"block": np.full(n, self.number), "kind": np.full(n, kind, np.int32)}
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _encode(docs: DataFrame, byte_path: str, piece_path: str, block_bytes: int) -> DataFrame:
    """Documents with their packed links, and the distinct pairs of every block."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, first = aligner(byte_path, piece_path), TaskContext.get().partitionId() << 32
        block = _Block(first)
        for batch in batches:
            for some in slices(batch):
                block.add(model, some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(1).nbytes)
                if block.bytes >= block_bytes:
                    yield from block.rows()
                    block = _Block(block.number + 1)
        if block.docs:
            yield from block.rows()

    return texts(docs).mapInArrow(work, _ENCODED)


def _counted(pairs: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best): documents that hold a pair linked, and whether no pair of its A id is held by more."""
    counts = written(pairs.groupBy("pair").agg(F.sum("held").alias("count")), "pair-counts")
    counts = counts.withColumn("a", F.expr(f"pair div {b_size}"))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))  # a row per A id at most: the vocabulary bounds it
    return counts.join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a_id, b_id, count, best) of every linked pair of ids."""
    b_size = aligner(byte_path, piece_path).b.size
    pairs = _encode(docs, byte_path, piece_path, block_bytes).where("kind = 0").select("pair", "held")
    return _counted(pairs, b_size).select(F.expr(f"int(pair div {b_size})").alias("a_id"), F.expr(f"int(pair % {b_size})").alias("b_id"), "count", "best")


def groups(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, group, start, end, a_ids, b_ids): every group with its byte range in the text with a space in front."""
    schema = pa.schema([("doc_id", pa.int64()), ("group", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                        ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = aligner(byte_path, piece_path)
        for batch in batches:
            for some in slices(batch):
                ids, t = some.column(0).to_pylist(), model.align(some.column(1).to_pylist())
                if not len(t.rows):
                    continue
                n = int(t.first_group[-1])
                many = np.diff(t.first_group)
                base = np.repeat(t.a_end[t.a_rows[1:] - 1] - np.diff(t.a_end[t.a_rows[1:] - 1], prepend=0), many)
                upto_a, upto_b = (np.cumsum(np.bincount(g, minlength=n)) for g in (t.a_group, t.b_group))
                end = t.b_end[upto_b - 1]
                start = np.concatenate([[0], end[:-1]])
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], u]), pa.int32()), pa.array(x, pa.int32())) for u, x in ((upto_a, t.a), (upto_b, t.b))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[r] for r in np.repeat(t.rows, many).tolist()], pa.int64()),
                    pa.array(np.arange(n) - np.repeat(t.first_group[:-1], many)), pa.array(start - base), pa.array(end - base), *lists], schema=schema)

    return texts(docs).mapInArrow(work, "doc_id long, group long, start long, end long, a_ids array<int>, b_ids array<int>")


def digest(docs: DataFrame, byte_path: str, piece_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document."""
    encoded = written(_encode(docs, byte_path, piece_path, block_bytes), "aligned")
    pairs = encoded.where("kind = 0").select("block", "pos", "pair", "held")
    counts = _counted(pairs, aligner(byte_path, piece_path).b.size)
    facts = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
    known = pairs.join(counts, "pair").select("block", F.lit(0).alias("kind"), "pos", "count", "best", *(F.lit(None).cast(encoded.schema[c].dataType).alias(c) for c in facts))
    rows = encoded.where("kind = 1").select("block", "kind", "pos", F.lit(None).cast("long").alias("count"), F.lit(None).cast("boolean").alias("best"), *facts)
    out = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])

    def judge(key: tuple, block: list[pa.RecordBatch], stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(b.num_rows for b in block)
        count, best = np.zeros(n, np.int64), np.zeros(n, bool)
        for b in block:
            pos = b.column(2).to_numpy()
            count[pos] = b.column(3).to_numpy()
            best[pos] = b.column(4).to_numpy(zero_copy_only=False)
        for b in stream:
            sums = np.zeros((2, b.num_rows), np.int64)
            for k, data in enumerate(b.column(11)):
                index, times = unpack(data.as_py())
                sums[:, k] = times[best[index]].sum(), (times * count[index]).sum()
            yield pa.RecordBatch.from_arrays([b.column(5), b.column(6), b.column(7), b.column(8), b.column(9), pa.array(sums[0]), pa.array(sums[1]), b.column(10)], schema=out)

    met = known.unionByName(rows).repartition("block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(blocks_and_streams(1, judge), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
