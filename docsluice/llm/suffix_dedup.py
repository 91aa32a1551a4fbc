"""Removal of long repeated byte strings by bucket-pointer refinement over sampled suffixes.

A byte string of ``size`` bytes that also starts earlier (smaller doc_id, or same document and earlier start) is removed
wherever it stands.  Suffixes are sampled: in every window of ``size`` bytes the q-gram with the least scrambled hash
is the window's anchor, so equal windows have equal anchors at equal offsets, and only a few suffixes in a hundred move.

1. Initial buckets: anchors are sorted by the identifier of their q-gram.  A bucket with one suffix is done.
2. Refinement: a bucket is sorted by the identifier of what stands around the anchor, as far as any of its windows
   reach.  Suffixes that agree are settled at once: all their windows but the earliest suffix's are repeats.
3. Where a bucket splits, the earliest suffix of each part is refined once more by the identifiers of the windows at
   each later offset; the same routine settles those.

Identifiers are 64-bit polynomial hashes of exact byte ranges, always compared together with the bucket's own hash.
Before each shuffle a batch keeps one suffix per identifier and turns the others into settled ranges, spread at random,
so a passage that most documents share sends a row per batch and not a row per document to its bucket.

doc_id is the key of a document; repeated rows are the same document and do not repeat themselves.  Rows with a null
doc_id match nothing and stay whole.  Null texts are empty.  Texts of any length are worked on in pieces.  An empty
table gives an empty result.  Columns of other names play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.llm.common import PIECE_BYTES, Bytes, checkpoint, lean, mix64, slices, utf8_rows

SIZE = 100  # bytes of a repeated string
GRAM = 36  # bytes of an anchor: longer ones are more often unique, shorter ones fewer
BROADCAST_IDS = 2_000_000  # ids that may travel to the scan (16 MB); more are met by a shuffle join

_SHIFT = np.uint64(21)
_MASK = np.uint64((1 << 21) - 1)


def _segments(bounds: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, first byte, past-the-last byte, first window, past-the-last window) of each text, long ones in pieces."""
    for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        n = int(b - a) - size + 1
        for w in range(0, n, PIECE_BYTES):
            stop = min(n, w + PIECE_BYTES)
            yield row, int(a) + max(0, w - size), int(a) + min(int(b - a), stop + 2 * size), int(a) + w, int(a) + stop


def _groups(segments: list) -> Iterator[list]:
    held, n = [], 0
    for s in segments:
        if held and n + s[2] - s[1] > PIECE_BYTES:
            yield held
            held, n = [], 0
        held.append(s)
        n += s[2] - s[1]
    if held:
        yield held


def anchors(raw: np.ndarray, bounds: np.ndarray, size: int, gram: int, contexts: bool = True, windows: bool = True) -> Iterator[dict[str, np.ndarray]]:
    """Anchors of texts that lie one after the other, with ``contexts``: row, start in the text, reach to the left and
    right, q-gram and context identifiers; with ``windows``: the windows' rows, starts, anchors and the anchors' q-grams."""
    wide = size - gram + 1
    for group in _groups(list(_segments(bounds, size))):
        rows = np.array([g[0] for g in group])
        lengths = np.array([g[2] - g[1] for g in group])
        x = np.concatenate([raw[g[1] : g[2]] for g in group])
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        body = Bytes(x)
        ids = body.grams(gram)
        key = ((ids >> _SHIFT) << _SHIFT) | np.arange(len(ids), dtype=np.uint64)
        m, span = key, 1
        while span * 2 <= wide:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        least = np.minimum(m[: len(key) - wide + 1], m[wide - span : wide - span + len(key) - wide + 1])
        del key, m
        starts = np.concatenate([np.arange(g[3] - g[1], g[4] - g[1]) + b for g, b in zip(group, begin)])
        at = (least[starts] & _MASK).astype(np.int64)
        shift = np.array([g[1] - bounds[g[0]] for g in group]) - begin  # from place in the group to place in the text
        out = {}
        if windows:
            own = np.repeat(np.arange(len(group)), [g[4] - g[3] for g in group])
            out = {"w_row": rows[own], "w_start": starts + shift[own], "w_anchor": at + shift[own], "w_gram": ids[at].view(np.int64)}
        if not contexts:
            yield out
            continue
        flag = np.zeros(len(ids), bool)
        flag[at] = True
        del least, starts, at
        spot = np.flatnonzero(flag)
        seg = np.searchsorted(begin, spot, side="right") - 1
        # The text's own edges, where they are inside the piece, end the context.
        left = np.maximum(begin[seg], spot - wide + 1)
        right = np.minimum(begin[seg] + lengths[seg], spot + size)
        context = body.hash(left, right) ^ mix64((spot - left).astype(np.uint64) << np.uint64(32) | (right - spot).astype(np.uint64))
        yield out | {"row": rows[seg], "at": spot + shift[seg], "left": spot - left, "right": right - spot, "gram": ids[spot].view(np.int64), "context": context.view(np.int64)}


_ROWS = "h long, c long, doc_id long, at long"


def _pack(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return at << 16 | left << 8 | right


def _settle(h: np.ndarray, c: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """One suffix per identifier of a batch; the others become settled ranges, merged per document and dealt at random."""
    order = np.lexsort((at, doc, c, h))
    h, c, doc, at = h[order], c[order], doc[order], at[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    same = (doc == doc[lead]) & (at == at[lead])  # a repeated row is not earlier than itself
    later = ~first & ~same
    d, lo, hi = merge(doc[later], *reach(at[later]))
    spread = mix64(d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.astype(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(x)) for x in ((h[first], spread), (c[first], hi), (doc[first], d), (at[first], -1 - lo))], ["h", "c", "doc_id", "at"]
    )


def reach(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spot = at >> 16
    return spot - (at >> 8 & 255), spot + (at & 255)


def merge(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching ranges per document."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    group = np.cumsum(new) - 1
    step = int(hi.max()) + 1
    far = np.maximum.accumulate(hi + group * step) - group * step  # the furthest end so far within the document
    new[1:] |= lo[1:] > far[:-1]
    heads = np.flatnonzero(new)
    return doc[heads], lo[heads], np.maximum.reduceat(hi, heads)


def _suffixes(size: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            raw, bounds = utf8_rows(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = [(a["gram"], a["context"], ids[a["row"]], _pack(a["at"], a["left"], a["right"])) for a in anchors(raw, bounds, size, gram, windows=False)]
            if found:
                yield _settle(*(np.concatenate(x) for x in zip(*found)))

    return lean(work)


_SPANS = "h long, doc_id long, first long, body binary"


def _spans(size: int, gram: int):
    """Of each wanted anchor the bytes its windows cover: the windows a q-gram is the anchor of start side by side."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            raw, bounds = utf8_rows(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            spots, edges = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.asarray(batch.column(2).offsets)
            wanted = np.repeat(np.arange(len(ids)), np.diff(edges)).astype(np.int64) << 40 | spots
            wanted.sort()
            for a in anchors(raw, bounds, size, gram, contexts=False):
                key = a["w_row"].astype(np.int64) << 40 | a["w_anchor"]
                at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                ours = np.flatnonzero(wanted[at] == key)
                if not len(ours):
                    continue
                new = np.ones(len(ours), bool)
                new[1:] = key[ours[1:]] != key[ours[:-1]]
                heads = np.flatnonzero(new)
                lead, tail = ours[heads], ours[np.append(heads[1:], len(ours)) - 1]
                start = bounds[a["w_row"][lead]] + a["w_start"][lead]
                stop = bounds[a["w_row"][tail]] + a["w_start"][tail] + size
                body = pa.array([raw[i:j].tobytes() for i, j in zip(start, stop)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(a["w_gram"][lead]), pa.array(ids[a["w_row"][lead]]), pa.array(a["w_start"][lead]), body], ["h", "doc_id", "first", "body"])

    return lean(work)


def _windows(size: int):
    """Every window of a span with its identifier."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                raw, bounds = utf8_rows(some.column(3))
                n = np.diff(bounds) - size + 1
                row = np.repeat(np.arange(len(n)), n)
                shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first = bounds[row] - bounds[0] + shift
                ids = Bytes(raw[bounds[0] : bounds[-1]]).hash(first, first + size).view(np.int64)
                h, doc, start = (some.column(i).to_numpy(zero_copy_only=False)[row] for i in range(3))
                start = start + shift
                yield _settle(h, ids, doc, _pack(start, np.zeros_like(start), np.full_like(start, size)))

    return lean(work)


def _refine(split: bool):
    """Settle buckets that come sorted by (h, c, doc_id, at): ranges (lo, hi) that repeat, and with ``split`` the
    earliest suffix of each part of a bucket that has several parts (its place as ``lo``, ``hi`` null)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the bucket's latest leader: h, c, doc, at, whether it was sent on
        for batch in batches:
            h, c, doc, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            ranges = at < 0
            out_doc, out_lo, out_hi = [doc[ranges]], [-1 - at[ranges]], [c[ranges]]
            h, c, doc, at = h[~ranges], c[~ranges], doc[~ranges], at[~ranges]
            parts = []
            if len(h):
                if last is not None:
                    h, c, doc, at = (np.concatenate([[v], x]) for v, x in zip(last[:4], (h, c, doc, at)))
                new_h = np.ones(len(h), bool)
                new_h[1:] = h[1:] != h[:-1]
                first = new_h.copy()
                first[1:] |= c[1:] != c[:-1]
                lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
                later = ~first & ~((doc == doc[lead]) & (at == at[lead]))
                lo, hi = reach(at[later])
                out_doc.append(doc[later]), out_lo.append(lo), out_hi.append(hi)
                leaders = np.flatnonzero(first)
                if split:
                    fresh = new_h[leaders]
                    several = ~fresh
                    several[:-1] |= ~fresh[1:]  # another part of the same bucket follows
                    if last is not None and last[4]:
                        # The carried leader has parts before it; it was sent on when they were seen.
                        several[1:] |= ~fresh[1:]
                    send = leaders[several]
                    if last is not None and last[4]:
                        send = send[send > 0]
                    parts = [doc[send], at[send] >> 16]
                    tail = leaders[-1]
                    sent = bool(several[-1]) or (len(leaders) == 1 and last is not None and bool(last[4]))
                else:
                    tail, sent = leaders[-1], False
                last = (h[tail], c[tail], doc[tail], at[tail], sent)
            d, lo, hi = merge(*(np.concatenate(x) for x in (out_doc, out_lo, out_hi)))
            columns = [pa.array(d), pa.array(lo), pa.array(hi)]
            if len(parts) and len(parts[0]):
                columns = [pa.concat_arrays([x, y]) for x, y in zip(columns, (pa.array(parts[0]), pa.array(parts[1]), pa.nulls(len(parts[0]), pa.int64())))]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lo", "hi"])

    return lean(work)


def _body(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def with_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose doc_id is (``left_semi``) or is not (``left_anti``) among ids: at the scan if the ids are few enough."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def repeated_ranges(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(doc_id, lo, hi): byte ranges whose union, per document, is what repeats earlier strings of ``size`` bytes."""
    if not 0 < gram < size < 256:
        raise ValueError("need 0 < gram < size < 256")
    body = _body(docs).where("doc_id is not null")
    sorted_rows = body.mapInArrow(_suffixes(size, gram), _ROWS).repartition("h").sortWithinPartitions("h", "c", "doc_id", "at")
    first = checkpoint(sorted_rows.mapInArrow(_refine(True), "doc_id long, lo long, hi long"))
    split = first.where("hi is null").groupBy("doc_id").agg(F.sort_array(F.collect_set("lo")).alias("spots"))  # anchors of one document
    texts = with_ids(body, first.where("hi is null").select("doc_id").distinct())
    spans = texts.join(split, "doc_id").select("doc_id", "text", "spots").mapInArrow(_spans(size, gram), _SPANS)
    # Windows are made behind the shuffle and sorted where they are; the sort spills if a bucket is large.
    again = spans.repartition("h").mapInArrow(_windows(size), _ROWS).sortWithinPartitions("h", "c", "doc_id", "at")
    second = again.mapInArrow(_refine(False), "doc_id long, lo long, hi long")
    return checkpoint(first.where("hi is not null").unionAll(second))


def _ranges_per_document(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("__ranges"))


def _cut(body: bytes, ranges) -> tuple[bytes, int, int]:
    """What is left, how many bytes went, and in how many runs."""
    lo = np.array([r["lo"] for r in ranges], dtype=np.int64)
    hi = np.array([r["hi"] for r in ranges], dtype=np.int64)
    _, lo, hi = merge(np.zeros(len(lo), np.int64), lo, hi)
    stops = [0, *hi.tolist()]
    kept = b"".join(body[a:b] for a, b in zip(stops, [*lo.tolist(), len(body)]))
    return kept, len(body) - len(kept), len(lo)


def digest(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per document."""
    ranges = repeated_ranges(docs, size)
    ids = ranges.select("doc_id").distinct()
    body = _body(docs)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cut = [_cut(bytes(t), r) for t, r in zip(f["text"], f["__ranges"])]
            yield pd.DataFrame({
                "doc_id": f["doc_id"], "n_bytes": [len(t) for t in f["text"]], "n_removed": [c[1] for c in cut], "n_spans": [c[2] for c in cut],
                "kept_sha256": [hashlib.sha256(c[0]).hexdigest() for c in cut],
            })

    touched = with_ids(body, ids).join(_ranges_per_document(ranges), "doc_id").mapInPandas(
        work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    zero = F.lit(0).cast("long")
    whole = with_ids(body, ids, "left_anti").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")
    )
    return whole.unionAll(touched)


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Documents with the repeated bytes taken out of their texts; letters that a cut leaves in part go with it.

    ``n_chars``, where there is such a column, is counted anew.
    """
    ranges = repeated_ranges(docs, size)
    ids = ranges.select("doc_id").distinct()

    @F.pandas_udf("string")
    def cut(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_cut(t.encode("utf-8"), r)[0].decode("utf-8", "ignore") for t, r in zip(text, found)], dtype=object)

    touched = with_ids(docs, ids).join(_ranges_per_document(ranges), "doc_id")
    touched = touched.withColumn("text", cut(F.coalesce(F.col("text"), F.lit("")), F.col("__ranges")))
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return with_ids(docs, ids, "left_anti").unionByName(touched.select(docs.columns))
