"""Long texts as numbered parts: ordered pieces of a key become one text, cut by its characters into parts of one size.

Prefix sums of the pieces' lengths, over stretches of the order and then over stretches of a key, give every piece its
place in the key's whole text.  A piece is cut where parts end, and each part joins the slices that fall into it, so
no value holds more than a part's characters, whatever a key's pieces add up to.  The parts of a key in order are its
whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions import text as tx
from docsluice.functions.ranking import distributed_sum

PART_CHARS = 20_000


def with_ends(pieces: DataFrame, key: str, opening: DataFrame | None = None, closing: DataFrame | None = None) -> DataFrame:
    """Pieces with a first and a last one for each key: adds ``_rank``, to be ordered by first.

    opening, closing: key, text; keys that have no pieces get their ends all the same.
    """
    out = pieces.withColumn("_rank", F.lit(1))
    for rank, ends in ((0, opening), (2, closing)):
        if ends is not None:
            out = out.unionByName(ends.select(key, "text").withColumn("_rank", F.lit(rank)), allowMissingColumns=True)
    return out


def numbered_parts(
    pieces: DataFrame, key: str, order: list[str | Column], buckets: list[Column], between: str = "", part_chars: int = PART_CHARS,
    trim_end: bool = False,
) -> DataFrame:
    """(key, part, start, text): part numbers and starts count from 0, in characters of the whole text.

    pieces: key, ``text`` and what ``order`` and ``buckets`` (order-preserving prefixes of it) use; NULL texts are left
    out.  ``between`` stands in front of every piece but the first.  With ``trim_end`` white space at the very end goes.
    """
    rows = pieces.where(F.col("text").isNotNull()).withColumn("text", F.concat(F.lit(between), F.col("text")))
    placed = distributed_sum(rows, [key], order, buckets, F.length("text").cast("bigint"), out="start", whole="whole")
    first, last = F.col("start") == 0, F.col("start") + F.length("text") == F.col("whole")
    text = F.when(first, F.expr(f"substring(text, {len(between) + 1})")).otherwise(F.col("text"))
    shown = placed.select(key, F.when(first, 0).otherwise(F.col("start") - len(between)).alias("start"), text.alias("text"), last.alias("last"))
    if trim_end:
        shown = shown.withColumn("text", F.when(F.col("last"), F.rtrim(F.col("text"), F.lit(tx.WS_LIST))).otherwise(F.col("text")))
    room = (F.lit(part_chars) - F.col("start") % part_chars).cast("int")
    rest = F.regexp_extract_all(F.substring("text", room + 1, F.length("text")), F.lit(f"(?s).{{1,{part_chars}}}"), F.lit(0))
    slices = F.when(F.length("text") <= room, F.array("text")).otherwise(F.concat(F.array(F.substring("text", F.lit(1), room)), rest))
    cut = shown.where(F.length("text") > 0).select(key, "start", F.posexplode(slices).alias("nth", "slice"))
    part = F.floor(F.col("start") / part_chars) + F.col("nth")
    at = F.when(F.col("nth") == 0, F.col("start")).otherwise(part * part_chars)
    met = cut.select(key, part.cast("bigint").alias("part"), F.struct(at.alias("at"), "slice").alias("slice")).groupBy(key, "part")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("slice")), lambda s: s["slice"]), "")
    return met.agg(joined.alias("text")).select(key, "part", (F.col("part") * part_chars).alias("start"), "text")
