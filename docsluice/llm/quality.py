"""A byte-level convolutional network in numpy that scores the quality of whole texts.

A text is read as UTF-8 bytes.  Windows of ``WIDTH`` bytes, ``STRIDE`` apart, are embedded and meet ``FILTERS`` learned
filters; a window also knows which share of its bytes repeats four-byte strings of the 40 bytes before it.  Windows are
grouped into overlapping chunks that cover the whole text; responses are max-pooled in each chunk, a linear layer makes
a chunk's logit, and the mean of the logits gives the probability.  Nothing but the text is an input.

The network is fitted on the driver on a bounded sample (``SAMPLE_PER_CLASS`` labelled rows of each class, ordered by a
hash of doc_id, ``TRAIN_CHUNKS`` chunks each; of texts over ``SAMPLE_BYTES`` that many bytes from evenly spaced places);
scoring reads every byte of every row.

A null text is empty; an empty text is one window of zero bytes and gets a score too.  Rows with a null doc_id are
scored and never used for fitting.  Repeated rows get repeated scores; a doc_id with contradicting labels counts as 0.
Without labels of both classes the score is the share of label 1 (1 without labels).  An empty table gives an empty
result.  Columns of other names play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.llm.common import give_back, utf8_rows

WIDTH, STRIDE, EMBED, FILTERS = 12, 4, 6, 32
CHUNK, HOP = 96, 80  # windows in a chunk, and from one chunk to the next
LAGS = 40
SAMPLE_PER_CLASS, SAMPLE_BYTES, TRAIN_CHUNKS = 900, 1 << 16, 6
EPOCHS, BATCH, RATE = 14, 32, 4e-3
BLOCK = 1 << 18  # bytes scored at once


@dataclass
class Net:
    """Weights; with ``constant`` set the network is not used."""

    embed: np.ndarray
    filters: np.ndarray  # (WIDTH * EMBED + 2, FILTERS): embedded bytes, repeat share, one
    out: np.ndarray
    bias: float
    constant: float | None = None


def repeats(raw: np.ndarray) -> np.ndarray:
    """Which bytes begin a four-byte string that also begins 1 to LAGS bytes earlier."""
    n = len(raw)
    if n < 5:
        return np.zeros(n, np.uint8)
    wide = np.zeros(n, np.uint32)
    b = raw.astype(np.uint32)
    wide[: n - 3] = b[: n - 3] | b[1 : n - 2] << 8 | b[2 : n - 1] << 16 | b[3:] << 24
    hit = np.zeros(n, bool)
    for lag in range(1, min(LAGS, n - 4) + 1):
        hit[lag : n - 3] |= wide[lag : n - 3] == wide[: n - 3 - lag]
    return hit.view(np.uint8)


def windows(n: int) -> np.ndarray:
    """Window starts that cover n bytes."""
    last = max(0, n - WIDTH)
    starts = np.arange(0, last + 1, STRIDE)
    return starts if starts[-1] == last else np.append(starts, last)


def chunks(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last window of each chunk that covers n windows."""
    first = np.arange(0, max(1, n - CHUNK + HOP), HOP)
    return first, np.minimum(first + CHUNK, n)


def _inputs(raw: np.ndarray, seen: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spots = starts[:, None] + np.arange(WIDTH)
    return raw[spots], seen[spots].mean(axis=1, dtype=np.float32)


def _responses(net: Net, codes: np.ndarray, share: np.ndarray) -> np.ndarray:
    x = np.empty((len(codes), WIDTH * EMBED + 2), np.float32)
    x[:, : WIDTH * EMBED] = net.embed[codes].reshape(len(codes), -1)
    x[:, -2], x[:, -1] = share, 1
    return np.maximum(x @ net.filters, 0)


def score_text(net: Net, raw: np.ndarray) -> float:
    """The probability of one text of any length, block by block."""
    if net.constant is not None:
        return net.constant
    if len(raw) < WIDTH:
        raw = np.concatenate([raw, np.zeros(WIDTH - len(raw), np.uint8)])
    total, count, step = 0.0, 0, HOP * max(1, BLOCK // STRIDE // HOP)
    starts = windows(len(raw))
    first, last = chunks(len(starts))
    for at in range(0, len(first), step // HOP):
        f, e = first[at : at + step // HOP], last[at : at + step // HOP]
        own = starts[f[0] : e[-1]]
        back = max(0, own[0] - LAGS)
        part = raw[back : own[-1] + WIDTH + 3]
        r = _responses(net, *_inputs(part, repeats(part), own - back))
        pooled = np.maximum.reduceat(np.concatenate([r, r[:1]]), np.stack([f - f[0], e - f[0]], 1).ravel())[::2]
        total += float((pooled @ net.out + net.bias).sum())
        count += len(f)
    return float(1 / (1 + np.exp(-np.clip(total / count, -30, 30))))


def fit(samples: list[bytes], labels: list[int], seed: int = 7) -> Net:
    """Adam on the mean logit of a text's sampled chunks; classes weigh alike."""
    y = np.array(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Net(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, float(y.mean()) if len(y) else 1.0)
    rng = np.random.default_rng(seed)
    codes, shares, owner = [], [], []
    for i, text in enumerate(samples):
        raw = np.frombuffer(text, np.uint8)
        raw = np.concatenate([raw, np.zeros(max(0, WIDTH - len(raw)), np.uint8)])
        starts, seen = windows(len(raw)), repeats(raw)
        first, last = chunks(len(starts))
        for k in np.unique(np.linspace(0, len(first) - 1, TRAIN_CHUNKS).astype(int)):
            c, s = _inputs(raw, seen, starts[first[k] : last[k]])
            fill = CHUNK - len(c)
            codes.append(np.pad(c, ((0, fill), (0, 0)), mode="edge"))
            shares.append(np.pad(s, (0, fill), mode="edge"))
            owner.append(i)
    codes, shares, owner = np.stack(codes), np.stack(shares), np.array(owner)
    by_text = np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1)
    weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
    net = Net(
        rng.normal(0, 0.3, (256, EMBED)).astype(np.float32),
        rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED + 2, FILTERS)).astype(np.float32),
        rng.normal(0, 0.2, FILTERS).astype(np.float32),
        0.0,
    )
    moments = {k: [0.0, 0.0] for k in ("embed", "filters", "out", "bias")}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            mine = np.concatenate([by_text[i] for i in rows])
            text_of = np.repeat(np.arange(len(rows)), [len(by_text[i]) for i in rows])
            size = np.bincount(text_of, minlength=len(rows)).astype(np.float32)
            flat, share = codes[mine].reshape(-1, WIDTH), shares[mine].reshape(-1)
            x = np.empty((len(flat), WIDTH * EMBED + 2), np.float32)
            x[:, : WIDTH * EMBED] = net.embed[flat].reshape(len(flat), -1)
            x[:, -2], x[:, -1] = share, 1
            r = (x @ net.filters).reshape(len(mine), CHUNK, FILTERS)
            top = r.argmax(axis=1)
            best = np.take_along_axis(r, top[:, None], 1)[:, 0]
            pooled = np.maximum(best, 0)
            logit = np.bincount(text_of, pooled @ net.out, len(rows)) / size + net.bias
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            d = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            d_chunk = (d / size)[text_of]
            grad = {"out": pooled.T @ d_chunk + 1e-4 * net.out, "bias": d.sum()}
            d_best = d_chunk[:, None] * net.out * (best > 0)
            spots = (np.arange(len(mine))[:, None] * CHUNK + top).ravel()
            which = np.tile(np.arange(FILTERS), len(mine))
            flow, seen = d_best.ravel(), x[spots]
            g = np.zeros_like(net.filters)
            for f in range(FILTERS):
                g[:, f] = flow[f::FILTERS] @ seen[f::FILTERS]
            grad["filters"] = g + 1e-4 * net.filters
            d_x = flow[:, None] * net.filters.T[which][:, : WIDTH * EMBED]
            ge = np.zeros_like(net.embed)
            np.add.at(ge, flat[spots].ravel(), d_x.reshape(-1, EMBED))
            grad["embed"] = ge
            step += 1
            for k, value in grad.items():
                m = moments[k]
                m[0] = 0.9 * m[0] + 0.1 * value
                m[1] = 0.99 * m[1] + 0.01 * value * value
                setattr(net, k, getattr(net, k) - (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)).astype(np.float32) if k != "bias" else float(net.bias - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)))
    return net


def held_out(doc_id: Column) -> Column:
    """Rows that never give a label: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Net:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    known = (
        labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # Of a long text, slices from evenly spaced places, the beginning and the end among them.
    size, slices = SAMPLE_BYTES // TRAIN_CHUNKS, range(TRAIN_CHUNKS)
    place = lambda i: (F.floor((F.octet_length(text) - size) * i / (TRAIN_CHUNKS - 1)) + 1).cast("int")
    spaced = F.concat(*[F.substring(text, place(i), F.lit(size)) for i in slices])
    body = docs.select("doc_id", F.when(F.octet_length(text) <= SAMPLE_BYTES, text).otherwise(spaced).alias("text"))
    rows = []
    for value in (0, 1):
        # A bounded sample: the smallest hashes of each class.  The few chosen ids then meet the texts.
        chosen = known.where(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        rows += body.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "quality").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    return fit([bytes(r["text"]) for r in rows], [r["quality"] for r in rows])


def _scores(net: Net, column: pa.Array) -> np.ndarray:
    raw, bounds = utf8_rows(column)
    return np.array([score_text(net, raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], dtype=np.float64)


def score_documents(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, score): every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(shared.value, batch.column(1)))], ["doc_id", "score"])

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(work, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document."""
    scored = score_documents(docs, fit_on(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of documents whose score is at least ``least``, with all their columns; only texts visit Python."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_on(docs, labels))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        scores = pa.array(_scores(shared.value, text))
        give_back()
        return scores

    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumn("__llm_score", score(body)).where(F.col("__llm_score") >= least).drop("__llm_score")
