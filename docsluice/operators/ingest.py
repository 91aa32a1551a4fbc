"""Ingest plan: incoming files against existing ones, candidate links, names and attachment checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsluice.functions import text as tx
from docsluice.functions.ranking import distributed_rank, distributed_sum, ordered_bucket
from docsluice.session import cut_lineage

# Thresholds and reasons.
REPLACE_PDF_BELOW = 98_304
MIN_ATTACHMENT_BYTES = 16
DUPLICATE_VARIANT = "duplicate_local_variant"
_NUMBERED = r"(?s)^(.*) \(([1-9]\d{0,17})\)$"
FILE_EXT = r"\.(pdf|docx?|zip|rar|7z|xlsx?|csv|txt|pptx?)$"


def canonical_pick(files: DataFrame, folder: str = "folder") -> DataFrame:
    """One winner per canonical name and its source: the largest, then the newest, then the first.

    files: folder, name, size, mtime, ord.  A maximum of structs combines before the shuffle, whatever a name's share.
    """
    named = files.withColumn("dest_name", tx.canonical_download_name(F.col("name")))
    best = F.max_by("name", F.struct("size", "mtime", -F.col("ord")))
    return named.groupBy(folder, "dest_name").agg(best.alias("source_name"), F.count("*").alias("n_variants"))


def omitted_variants(files: DataFrame, picks: DataFrame, folder: str = "folder") -> DataFrame:
    """Files that lost to another variant of their name."""
    named = files.withColumn("dest_name", tx.canonical_download_name(F.col("name")))
    losers = named.join(picks.where("n_variants > 1"), [folder, "dest_name"])
    return losers.where(F.col("name") != F.col("source_name")).select(
        folder, "name", F.lit(DUPLICATE_VARIANT).alias("reason")
    )


def skip_existing(incoming: DataFrame, existing: DataFrame, folder: str = "folder", replace_small_pdf: bool = True) -> DataFrame:
    """Add ``action``: upload what is new, skip what exists, replace an existing PDF that is suspiciously small.

    existing: folder, name, size (text), ord; of several files with a name the first counts.
    """
    size = F.coalesce(F.try_to_number(F.regexp_extract(F.col("size").cast("string"), r"^\s*(\d+)", 1), F.lit("9" * 18)), F.lit(0))
    have = existing.groupBy(folder, "name").agg(F.min_by(size, "ord").alias("_size"), F.lit(True).alias("_exists"))
    joined = incoming.join(have, [folder, "name"], "left")
    small = F.lower("name").endswith(".pdf") & (F.col("_size") > 0) & (F.col("_size") < REPLACE_PDF_BELOW)
    action = F.when(F.col("_exists").isNull(), "upload")
    if replace_small_pdf:
        action = action.when(small, "replace")
    return joined.select(*incoming.columns, action.otherwise("skip").alias("action"))


def download_outcomes(planned: DataFrame, results: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Planned downloads ⋈ batch results on the item: ok or the error; results without an item are ignored."""
    joined = planned.join(results, on or ["tender_id", "item_id"])
    good = F.coalesce("ok", F.lit(False)) & F.coalesce(F.col("path") != "", F.lit(False))
    return joined.select(
        *planned.columns,
        F.when(good, "ok").otherwise("error").alias("outcome"),
        F.when(~good, F.concat_ws(": ", "url", F.coalesce("error", F.lit("ошибка")))).alias("message"),
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("tender_id").agg(
        F.count_if(F.col("outcome") == "ok").alias("n_ok"), F.count("*").alias("n_planned")
    )


def union_candidates(from_page: DataFrame, from_network: DataFrame, help_link, key: str = "tender_id") -> DataFrame:
    """Links of a page, then network links not among them, each once; ``kept`` is false for platform manuals.

    Both: key, ord, url, link_text.  ``help_link(url, link_text, key)`` is the predicate of the manuals.  The first of
    equal links is a minimum, so a link found everywhere stays cheap.
    """
    both = from_page.withColumn("pass", F.lit(0)).unionByName(from_network.withColumn("pass", F.lit(1)))
    first = both.groupBy(key, "url").agg(F.min(F.struct("pass", "ord", "link_text")).alias("f"))
    rows = first.select(key, "url", "f.pass", "f.ord", "f.link_text")
    return rows.withColumn("kept", ~help_link(F.col("url"), F.col("link_text"), F.col(key)))




def _parsed(files: DataFrame, folder: str) -> DataFrame:
    """Names with base, extension, the name they are a numbered form of (``a (2).x`` of ``a.x``) and that number."""
    name, base, root = F.col("name"), F.col("base"), F.col("root")
    ext = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    rows = files.select(folder, "ord", "name").withColumn("ext", ext).withColumn("base", F.expr("substr(name, 1, length(name) - length(ext))"))
    number = F.nullif(F.regexp_extract(base, _NUMBERED, 2), F.lit(""))
    rows = rows.withColumn("n", number.cast("bigint")).withColumn("root", F.when(number.isNotNull(), F.regexp_extract(base, _NUMBERED, 1)))
    # Only what the numbering can make counts: from 2 on, and not of an extension alone.
    made = (F.col("n") >= 2) & ((root != "") | (F.col("ext") == ""))
    family = F.concat(F.regexp_replace("base", r"( \(\d+\))+$", ""), "ext")
    depth = F.size(F.split(F.regexp_extract("base", r"((?: \(\d+\))*)$", 1), r"\(")) - 1
    return rows.withColumn("parent", F.when(made, F.concat(root, "ext"))).withColumn("family", family).withColumn("depth", depth.cast("int")).drop("root")


def _blocked(literals: DataFrame, keys: list[str], rounds: int = 12) -> DataFrame:
    """Which numbers that stand literally in the input are kept from the repeats, and how many blocked ones are below.

    literals: keys, n, limit.  In order of n, a literal is blocked iff fewer than ``limit`` smaller ones are (for the
    repeat that would come to n then comes after it).  All are taken for blocked at first and judged anew by prefix sums
    until nothing changes, which settles them from the smallest up; what a few rounds leave open is settled in one pass
    in order that holds a count only.
    """
    rows = cut_lineage(literals.withColumn("blocked", F.lit(True)))
    bucket = [ordered_bucket(F.col("n"), rows)]
    for _ in range(rounds):
        summed = distributed_sum(rows, keys, ["n"], bucket, F.col("blocked").cast("bigint"), out="below")
        judged = cut_lineage(summed.withColumn("now", F.col("below") < F.col("limit")))
        if judged.where("blocked <> now").isEmpty():
            return judged.drop("now")
        rows = judged.select(*literals.columns, F.col("now").alias("blocked"))

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, below = None, 0
        for frame in frames:
            out = []
            for row in frame[[*keys, "limit"]].itertuples(index=False, name=None):
                if row[:-1] != key:
                    key, below = row[:-1], 0
                blocked = below < row[-1]
                out.append((blocked, below))
                below += blocked
            frame["blocked"], frame["below"] = [o[0] for o in out], [o[1] for o in out]
            yield frame

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "n")
    return dealt.mapInPandas(settle, T.StructType([*rows.schema.fields, T.StructField("below", T.LongType())]))


def _number_level(rows: DataFrame, taken: DataFrame | None, literals: DataFrame, folder: str) -> DataFrame:
    """(folder, ord, name, base, ext, number): names of one depth with the number each gets, NULL for the name itself.

    taken: folder, name, at — names that a repeat of their parent got, and when.  literals: folder, name, n, at — numbered
    forms of these names in the input, and when they first come.
    """
    keys = [folder, "name"]
    first = rows.groupBy(*keys).agg(F.min("ord").alias("first"), F.count("*").alias("many"))
    if taken is None:
        first = first.withColumn("own", F.lit(True))
    else:
        first = first.join(taken.withColumnRenamed("at", "taken_at"), keys, "left").withColumn("own", F.col("taken_at").isNull() | (F.col("first") < F.col("taken_at"))).drop("taken_at")
    marked = rows.join(first, keys).withColumn("again", ~(F.col("own") & (F.col("ord") == F.col("first"))))
    repeated = first.where(F.col("many") > F.col("own").cast("int")).select(*keys)
    none = F.lit(None)
    events = marked.select(*keys, "ord", "base", "ext", F.col("again").cast("bigint").alias("v"), none.cast("bigint").alias("n")).unionByName(
        literals.join(repeated, keys, "left_semi").select(*keys, F.col("at").alias("ord"), none.cast("string").alias("base"), none.cast("string").alias("ext"), F.lit(0).cast("bigint").alias("v"), "n")
    )
    counted = cut_lineage(distributed_sum(events, keys, ["ord"], [ordered_bucket(F.col("ord"), rows)], F.col("v"), out="before"))
    files = counted.where("n IS NULL").withColumn("k", F.when(F.col("v") == 1, F.col("before") + 1))
    limits = counted.where("n IS NOT NULL").select(*keys, "n", (F.col("n") - 1 - F.col("before")).alias("limit"))
    if limits.isEmpty():
        return files.select(folder, "ord", "name", "base", "ext", (F.col("k") + 1).alias("number"))
    # A repeat skips the blocked numbers below which fewer free ones lie than its rank.
    kept = _blocked(limits, keys).where("blocked").select(*keys, ((F.col("n") - 2 - F.col("below")) * 2 + 1).alias("place"), F.lit(1).cast("bigint").alias("skip"))
    repeats = files.where("k IS NOT NULL").select(*keys, "ord", "base", "ext", "k", (F.col("k") * 2).alias("place"), F.lit(0).cast("bigint").alias("skip"))
    both = cut_lineage(repeats.unionByName(kept, allowMissingColumns=True))
    skipped = distributed_sum(both, keys, ["place"], [ordered_bucket(F.col("place"), both)], F.col("skip"), out="skipped")
    numbered = skipped.where("k IS NOT NULL").select(folder, "ord", "name", "base", "ext", (F.col("k") + 1 + F.col("skipped")).alias("number"))
    return numbered.unionByName(files.where("k IS NULL").select(folder, "ord", "name", "base", "ext", F.lit(None).cast("bigint").alias("number")))


def unique_names(files: DataFrame, folder: str = "folder") -> DataFrame:
    """Add ``dest_name``: the second file of a name becomes ``base (2).ext`` and so on, in order.

    files: folder, ord (unique, numeric), name.  A repeat gets the least number whose name no earlier file has or got.
    Repeats are ranked; where the input itself holds numbered forms of a repeated name, ranks become numbers by counting
    the literal numbers that are in their way, as prefix sums over stretches.  Names of one depth of numbering are done
    together, then those that they may have taken the place of.  No family of names meets in one task.
    """
    rows = _parsed(files, folder)
    mixed = rows.groupBy(folder, "family").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b").select(folder, "family")
    clear = rows.join(mixed, [folder, "family"], "left_anti")
    ranked = distributed_rank(clear, [folder, "name"], ["ord"], [ordered_bucket(F.col("ord"), files)], out="nth")
    done = ranked.select(folder, "ord", "name", "base", "ext", F.when(F.col("nth") > 1, F.col("nth")).alias("number"))
    tangled = cut_lineage(rows.join(mixed, [folder, "family"], "left_semi"))
    deepest = tangled.agg(F.max("depth")).first()[0]
    taken = None
    for depth in range(0 if deepest is None else deepest + 1):
        deeper = tangled.where((F.col("depth") == depth + 1) & F.col("parent").isNotNull())
        literals = deeper.groupBy(folder, F.col("parent").alias("name"), "n").agg(F.min("ord").alias("at"))
        level = cut_lineage(_number_level(tangled.where(F.col("depth") == depth), taken, literals, folder))
        taken = level.where("number IS NOT NULL").select(folder, _with_number().alias("name"), F.col("ord").alias("at"))
        done = done.unionByName(level)
    return done.select(folder, "ord", "name", F.when(F.col("number").isNull(), F.col("name")).otherwise(_with_number()).alias("dest_name"))


def _with_number() -> Column:
    return F.concat("base", F.lit(" ("), F.col("number").cast("string"), F.lit(")"), "ext")


def _starts_like_html(content: Column) -> Column:
    head = F.lower(tx.decode_utf8(F.substring(content, 1, 500)))
    return (F.length(content) >= 8) & (
        tx.js_trim(head).startswith("<") | head.contains("<!doctype") | head.contains("<html")
    )


def attachment_kind(content: Column) -> Column:
    """pdf, zip, doc, html or unknown by the first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(F.coalesce(F.length(content) < 4, F.lit(True)), "unknown")
        .when(_starts_like_html(content), "html")
        .when(head == "25504446", "pdf")
        .when(head == "504B0304", "zip")
        .when(head == "D0CF11E0", "doc")
        .otherwise("unknown")
    )


def attachment_ok(content: Column, name: Column, content_type: Column, size: Column | None = None) -> Column:
    """Struct (ok, reason) for a downloaded attachment, from its content or from its beginning and its size."""
    size = F.length(content) if size is None else size
    low, kind = F.lower(name), attachment_kind(content)
    fits = (low.rlike(r"\.(docx|xlsx|pptx|zip)$") & (kind == "zip")) | (low.endswith(".doc") & kind.isin("doc", "zip"))
    pdf = low.endswith(".pdf")
    reason = (
        F.when(kind == "html", "html")
        .when(F.coalesce(size < MIN_ATTACHMENT_BYTES, F.lit(True)), "too_short")
        .when(fits, None)
        .when(pdf & (kind != "pdf"), "not_pdf")
        .when(pdf & F.lower(F.coalesce(content_type, F.lit(""))).contains("text/html"), "content_type_html")
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def file_name_from(link_text: Column, url: Column, disposition: Column) -> Column:
    """Name of a download: the link text with an extension, else the Content-Disposition, else the URL's last segment."""
    ext = "(?i)" + FILE_EXT
    text = tx.js_trim(link_text)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segment = F.coalesce(F.nullif(F.regexp_extract(path, r"([^/]*)$", 1), F.lit("")), F.lit("download"))
    guessed = F.coalesce(F.try_url_decode(segment), segment)
    quoted = F.regexp_extract(disposition, r'(?i)filename\*?=(?:UTF-8\'\'|")?([^";]+)', 1)
    named = F.nullif(F.trim(quoted), F.lit(""))
    candidate = F.coalesce(F.coalesce(F.try_url_decode(named), named), guessed)
    number = F.regexp_extract(url, r"[?&]n=(\d+)(?:[&#]|$)", 1)
    default = F.when((number != "") & F.lower(path).contains("getfile"), F.concat(F.lit("document-"), number, F.lit(".pdf")))
    by_segment = F.when(segment.rlike(r"(?i)\.(pdf|docx?|zip|rar|7z)$"), guessed)
    fallback = F.coalesce(default, by_segment, F.lit("download.pdf"))
    chosen = F.when(text.rlike(ext), text).when(candidate.rlike(ext), candidate).otherwise(fallback)
    return tx.safe_name(tx.js_trim(chosen), 180, "file", " ")
