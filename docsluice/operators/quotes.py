"""Where quotes stand in the text of their tender: many quotes meet a text at once.

Texts are cut into cells of bounded size, each with as much of what follows as the longest quote of its tender may
need.  A task indexes the n-grams of a cell by position; of every quote that could stand there it looks up a few grams,
takes the rarest in the cell, and verifies the quote in place at that gram's positions.  A quote with a gram that the
cell lacks is done with at once, so a cell is read once however many quotes ask for it.

A tender's quotes go in blocks and its text in spans of bounded size, and every block meets every span: a tender that
holds most quotes, or most text, is work for many tasks.  Most tenders have one block and one span; only the others,
whose number is bounded by the amount of text, are told to the tasks, so quotes travel once.  Only hits leave a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.functions.patterns import WS
from docsluice.functions.text import is_ascii, uniform_quotes

GRAM = 14  # characters of an indexed gram; shorter quotes are not looked up
CHUNK_CHARS = 1 << 14  # texts are normalised in chunks of so many characters
CELL_CHARS, SPAN_CELLS = 1 << 15, 32  # a cell is at least twice the longest quote of its tender
BLOCK_CHARS = 1 << 21  # of quotes in a block
PROBES = 16  # grams of a quote that are looked up
MANY = 64  # positions of the rarest gram from which a plain search is used instead
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def long_quotes(quotes: Column) -> Column:
    """The quotes that are looked up."""
    return F.filter(quotes, lambda q: F.length(q["quote"]) >= GRAM)


def unit_id(quotes: Column) -> Column:
    """Sixteen bytes that stand for the quotes of an array that are looked up."""
    return F.unhex(F.md5(F.to_json(long_quotes(quotes))))


def normalized_chunks(corpora: DataFrame, text: str = "corpus") -> DataFrame:
    """(tender_id, start, chunk): texts with quotes unified and white space collapsed, in chunks that join to a whole.

    corpora: tender_id, a text, and ``part`` where a text comes in numbered parts that follow each other.  White space
    that a cut goes through is one blank, as it is in the whole text; chunks know the end of the one before, parts that
    of the part before.
    """
    numbered = "part" in corpora.columns
    # A constant is no key of a window: with one in the exchange, the text would travel again.
    part, keys = (F.col("part"), ["tender_id", "part"]) if numbered else (F.lit(0), ["tender_id"])
    raw = corpora.select("tender_id", part.cast("bigint").alias("part"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{CHUNK_CHARS}}}"), F.lit(0))).alias("sub", "raw"))
    # The blanks of ASCII are found faster than those of all scripts.
    one_blank = F.when(is_ascii(F.col("raw")), F.regexp_replace("raw", r"\s+", " ")).otherwise(F.regexp_replace(uniform_quotes(F.col("raw")), f"{WS}+", " "))
    # Dealt by part before anything is derived, so that both uses below share one exchange.
    rows = raw.select("tender_id", "part", "sub", one_blank.alias("chunk")).repartition(*keys)
    inner = Window.partitionBy("tender_id", "part").orderBy("sub")
    opens, closes = F.startswith("chunk", F.lit(" ")), F.endswith("chunk", F.lit(" "))
    within = rows.withColumn("before", F.lag(closes).over(inner))
    # What a part adds up to: its first chunk's blank stays or goes with the part before.
    whole = within.groupBy("tender_id", "part").agg(
        F.sum(F.length("chunk") - F.when(opens & F.coalesce("before", F.lit(False)), 1).otherwise(0)).alias("size"),
        F.min_by(opens, "sub").alias("first_opens"), F.max_by(closes, "sub").alias("last_closes"),
    )
    outer = Window.partitionBy("tender_id").orderBy("part")
    led = whole.withColumn("led", F.coalesce(F.lag("last_closes").over(outer), F.lit(True)))  # a text begins as if behind a blank
    net = F.col("size") - F.when(F.col("first_opens") & F.col("led"), 1).otherwise(0)
    starts = led.select("tender_id", "part", "led", F.coalesce(F.sum(net).over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    known = within.join(starts, ["tender_id", "part"])
    kept = known.select(
        "tender_id", "part", "sub", "base", F.when(opens & F.coalesce("before", "led"), F.substring("chunk", 2, CHUNK_CHARS)).otherwise(F.col("chunk")).alias("chunk")
    )
    earlier = F.sum(F.length("chunk")).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    return kept.select("tender_id", (F.col("base") + F.coalesce(earlier, F.lit(0))).alias("start"), "chunk")


def _gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the gram at every position."""
    h = codes.astype(np.uint64)
    for step, k in zip((1, 2, 4), _STEPS):
        h = (h[:-step] * k) ^ (h[:-step] >> np.uint64(29)) ^ h[step:] if len(h) > step else h[:0]
    rest = GRAM - 8
    return h[:-rest] * _STEPS[3] + h[rest:] if len(h) > rest else h[:0]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class QuoteIndex:
    """The quotes of a block with the hashes of some of their grams."""

    def __init__(self, quotes: list[str]):
        self.quotes = quotes
        sizes = np.array([len(q) for q in quotes])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        hashes = _gram_hashes(_codes("".join(quotes)))
        last = sizes - GRAM
        self.probes = np.minimum(PROBES, last // GRAM + 2)  # evenly spaced, the first and the last gram among them
        self.first = np.concatenate([[0], np.cumsum(self.probes)])
        nth = np.arange(self.first[-1]) - np.repeat(self.first[:-1], self.probes)
        self.shift = np.repeat(last, self.probes) * nth // np.repeat(self.probes - 1, self.probes)
        self.hash = hashes[np.repeat(starts, self.probes) + self.shift]

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """(quote, first place) of the quotes that stand in a text."""
        here = _gram_hashes(_codes(text))
        order = np.argsort(here, kind="stable")
        here = here[order]
        left = np.searchsorted(here, self.hash, "left")
        many = np.searchsorted(here, self.hash, "right") - left
        fewest = np.minimum.reduceat(many, self.first[:-1])
        for k in np.flatnonzero(fewest).tolist():
            quote = self.quotes[k]
            if fewest[k] > MANY:
                at = text.find(quote)
                if at >= 0:
                    yield k, at
                continue
            rarest = self.first[k] + int(np.argmin(many[self.first[k] : self.first[k + 1]]))
            for at in np.sort(order[left[rarest] : left[rarest] + many[rarest]] - self.shift[rarest]).tolist():
                if at >= 0 and text.startswith(quote, at):
                    yield k, at
                    break


def locate(units: DataFrame, corpora: DataFrame, slots: int, text: str = "corpus") -> DataFrame:
    """(tender_id, unit, at_0, at_1, …): the first place of a quote of each slot in the normalised text, NULL if none.

    units: tender_id, quotes array<struct<slot int, quote string>>, quotes normalised.  Units are told apart by
    ``unit_id``; those of which nothing is found have no row, as have tenders without text.  A tender may have one text
    or numbered parts of one.
    """
    corpora = corpora.where(F.col("tender_id").isNotNull())
    asked = units.where(F.col("tender_id").isNotNull()).select("tender_id", long_quotes(F.col("quotes")).alias("long"))
    # Blocks follow from the size of distinct units; a hash tells them apart well enough for that.
    weight = F.aggregate("long", F.lit(32), lambda sum_, q: sum_ + F.length(q["quote"]) + 24)
    each = asked.select("tender_id", F.xxhash64("long").alias("h"), weight.alias("w"), F.array_max(F.transform("long", lambda q: F.length(q["quote"]))).alias("n"))
    once = each.groupBy("tender_id", "h").agg(F.max("w").alias("w"), F.max("n").alias("n"))
    sizes = once.groupBy("tender_id").agg(F.ceil(F.sum("w") / BLOCK_CHARS).alias("blocks"), F.max("n").alias("longest"))
    raw = corpora.groupBy("tender_id").agg(F.sum(F.length(text).cast("bigint")).alias("total"))
    # Tenders of more than one block or span: each has a block of quotes or a span of text, so they are few beside either.
    size = F.greatest(F.lit(CELL_CHARS), F.col("longest") * 2).cast("bigint")
    many = sizes.join(raw, "tender_id", "full").where((F.col("blocks") > 1) | (F.col("total") > CELL_CHARS * SPAN_CELLS))
    many = F.broadcast(many.select("tender_id", F.coalesce("blocks", F.lit(1)).alias("blocks"), "longest", size.alias("size"), "total"))
    spans = F.expr(f"if(total is null, array(0l), sequence(0l, greatest(0l, total - 1) div (size * {SPAN_CELLS})))")
    body = asked.select("tender_id", F.to_json("long").alias("body"))
    quotes = (
        body.select("tender_id", F.unhex(F.md5("body")).alias("unit"), "body").join(many, "tender_id", "left")
        .select("tender_id", F.pmod(F.xxhash64("unit"), F.coalesce("blocks", F.lit(1))).cast("bigint").alias("block"), F.explode(spans).alias("span"), F.struct("unit", "body").alias("q"))
        .groupBy("tender_id", "block", "span").agg(F.collect_set("q").alias("quotes"))  # equal units are one before they travel
    )
    chunks = normalized_chunks(corpora, text).join(many, "tender_id", "left").withColumn("stop", F.col("start") + F.length("chunk"))
    reach = "size + longest - 1"
    cells = chunks.where("stop > start").withColumn(
        "cell", F.explode(F.expr(f"if(size is null, array(0l), sequence(greatest(0l, bigint(floor((start - ({reach})) / size)) + 1), (stop - 1) div size))"))
    ).withColumns({"low": F.expr("if(size is null, start, greatest(start, cell * size))"), "high": F.expr(f"if(size is null, stop, least(stop, cell * size + {reach}))")})
    texts = (
        cells.where("high > low")
        .select(
            "tender_id", F.explode(F.expr("sequence(0l, coalesce(blocks, 1l) - 1)")).alias("block"), F.expr(f"cell div {SPAN_CELLS}").alias("span"),
            F.struct("cell", F.col("low").alias("at"), F.expr("if(low = start and high = stop, chunk, substring(chunk, int(low - start + 1), int(high - low)))").alias("body")).alias("t"),
        )
        .groupBy("tender_id", "block", "span").agg(F.collect_list("t").alias("texts"))
    )
    met = quotes.join(texts, ["tender_id", "block", "span"]).select("tender_id", "quotes", "texts")
    kind = met.schema["tender_id"].dataType.simpleString()
    hits = met.mapInArrow(_search, f"tender_id {kind}, unit binary, slot int, at long")
    return hits.groupBy("tender_id", "unit").agg(*[F.min(F.when(F.col("slot") == k, F.col("at"))).alias(f"at_{k}") for k in range(slots)])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block of quotes and a span of text, to the first hit of every quote in the span."""
    for batch in batches:
        for i in range(batch.num_rows):
            quotes, texts = (batch.column(c)[i].as_py() for c in (1, 2))
            units, slots, places = [], [], []
            for unit, slot, at in _hits(quotes, texts):
                units.append(unit), slots.append(slot), places.append(at)
            if units:
                tender = batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(units), np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [tender, pa.array(units, pa.binary()), pa.array(slots, pa.int32()), pa.array(places, pa.int64())], names=["tender_id", "unit", "slot", "at"]
                )


def _hits(quotes: list[dict], texts: list[dict]) -> Iterator[tuple[bytes, int, int]]:
    """(unit, slot, first place) in the cells of a span."""
    askers: dict[str, list[tuple[bytes, int]]] = {}
    for r in quotes:
        for q in json.loads(r["body"]):
            askers.setdefault(q["quote"], []).append((r["unit"], q["slot"]))
    if not askers:
        return
    index, seen = QuoteIndex(list(askers)), set()
    longest = max(map(len, index.quotes))
    step = max(CELL_CHARS, 2 * longest)
    for _, some in groupby(sorted(texts, key=lambda t: (t["cell"], t["at"])), key=lambda t: t["cell"]):
        pieces = list(some)
        whole = "".join(t["body"] for t in pieces)
        for first in range(0, max(1, len(whole) - longest + 1), step):
            for k, at in index.find(whole[first : first + step + longest - 1]):
                if k not in seen:  # cells come in order, so the first hit is the first place
                    seen.add(k)
                    yield from ((unit, slot, pieces[0]["at"] + first + at) for unit, slot in askers[index.quotes[k]])
