"""Corpus assembly: many file texts → one text per tender, whole, in numbered parts of bounded size.

Nothing is left out unless a caller sets a budget.  What a budget reaches is decided on narrow rows (names, lengths);
``left_out`` has a row for every file that it cuts or does not reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.functions import text as tx
from docsluice.functions.ranking import distributed_sum, ordered_bucket
from docsluice.operators.parts import PART_CHARS, numbered_parts
from docsluice.session import cut_to_table

# Headers and marks of the assembled texts, and the shortest snippet.
SNIPPET_MIN_CHARS = 40
CUT_BUDGET = "\n…[файл усечён]"
FILE_HEADER = ("=== ", " ===\n")
FOLDER_HEADER = ("### Реквизиты · файл: ", "\n")
PARSE_ERROR = ": ошибка парсинга"
NO_FILE_FOR = ": не найден файл для "
MIN_ANALYSIS_CHARS, MIN_CARD_CHARS = 120, 400


def collapsed_length(c: Column) -> Column:
    return F.length(tx.collapse_ws(c))


def canonical_path(c: Column) -> Column:
    """Path below the inputs folder; NULL for a path elsewhere."""
    trimmed = tx.js_trim(c)
    return F.when(trimmed.startswith("inputs/"), F.regexp_replace(trimmed, "^inputs//*", ""))


def _usable(status: Column, path: Column) -> Column:
    return ~((F.coalesce(status, F.lit("")) == "error") | F.coalesce(tx.js_trim(path) == "", F.lit(True)))


def items_to_text(items: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest items ⋈ files by (tender, path): adds ``text``, ``not_parsed`` and ``warning``.

    items: tender_id, ord, name, status, path; files: tender_id, path, text.
    """
    keyed = items.withColumn("file_path", canonical_path(F.col("path")))
    found = files.select("tender_id", F.col("path").alias("file_path"), tx.js_trim(F.col("text")).alias("text"))
    joined = keyed.join(found, ["tender_id", "file_path"], "left")
    usable = _usable(F.col("status"), F.col("path"))
    missing = usable & F.col("text").isNull()
    named = F.coalesce(F.col("name") != "", F.lit(False))
    return joined.select(
        *items.columns,
        F.when(usable, F.nullif("text", F.lit(""))).alias("text"),
        F.when(~usable & named, F.col("name"))
        .when(missing, F.when(named, F.col("name")).otherwise(F.col("path")))
        .when(usable & (F.col("text") == ""), F.col("name"))
        .alias("not_parsed"),
        F.when(~usable & named & (F.col("status") == "error"), F.concat("name", F.lit(PARSE_ERROR)))
        .when(missing & named, F.concat("name", F.lit(NO_FILE_FOR), "path"))
        .alias("warning"),
    )


def joined_in_order(part: str, order: str, separator: str) -> Column:
    """Parts of a (bounded) group as one text."""
    sorted_parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(part).alias("p"))))
    return F.array_join(F.transform(sorted_parts, lambda x: x["p"]), separator)


def corpus_pieces(items: DataFrame, files: DataFrame) -> DataFrame:
    """(tender_id, ord, text): the texts of a manifest's usable items, each below its name and path."""
    texts = items_to_text(items, files).where(F.col("text").isNotNull())
    header = F.concat(F.lit("### Документ: "), "name", F.lit("\n_Путь: "), "path", F.lit("_\n\n"))
    return texts.select("tender_id", "ord", F.concat(header, "text").alias("text"))


def assemble_corpus(items: DataFrame, files: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(tender_id, part, start, text): the corpus of all usable items in order, in numbered parts."""
    pieces = corpus_pieces(items, files)
    return numbered_parts(pieces, "tender_id", ["ord"], [ordered_bucket(F.col("ord"), items)], "\n\n", part_chars)


def corpus_sizes(items: DataFrame, files: DataFrame) -> DataFrame:
    """(tender_id, n_files, input_chars): how long the corpus is with white space collapsed, without making it.

    Pieces begin and end with other characters, so one blank stands between two.
    """
    sizes = corpus_pieces(items, files).groupBy("tender_id").agg(F.count("*").alias("n_files"), F.sum(collapsed_length(F.col("text")).cast("bigint")).alias("n"))
    return sizes.select("tender_id", "n_files", (F.col("n") + F.col("n_files") - 1).alias("input_chars"))


def within_budget(sizes: DataFrame, budget: int, min_room: int, key: str, salts: int) -> DataFrame:
    """Rows (key, file_id, name, head, size) that a budget reaches in name order, with their ``room`` and rank.

    Running sums first go over hashed parts of each group: a file without room within its part has none in the whole,
    and leaving it out changes no decision, for whatever follows it is out of room too.  So a group that holds most of
    the rows is cut down in parallel, and the final window sees at most ``salts`` budgets per group.
    """
    order = [F.collate("name", "ru"), F.col("name"), F.col("file_id")]
    cost = (F.col("head") + F.col("size")).cast("bigint")

    def room(w) -> Column:
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        return F.lit(budget) - F.coalesce(F.sum(cost).over(before), F.lit(0)) - F.col("head")

    part = sizes.withColumn("salt", F.pmod(F.xxhash64("name", "file_id"), F.lit(salts)).cast("int"))
    near = part.withColumn("room", room(Window.partitionBy(key, "salt").orderBy(*order))).where(F.col("room") > min_room)
    whole = Window.partitionBy(key).orderBy(*order)
    ranked = near.drop("room", "salt").withColumn("room", room(whole)).withColumn("n", F.row_number().over(whole))
    return ranked.where(F.col("room") > min_room)


def _by_name(files: DataFrame) -> tuple[list[Column], list[Column]]:
    """The order of names, and the stretches it is cut into."""
    name = F.collate("name", "ru")
    return [name, F.col("name"), F.col("file_id")], [ordered_bucket(name, files)]


def _headed(header: tuple[str, str], text: Column) -> Column:
    return F.concat(F.lit(header[0]), F.col("name"), F.lit(header[1]), text)


def assemble_files(
    files: DataFrame, header: tuple[str, str] = FILE_HEADER, between: str = "\n\n", part_chars: int = PART_CHARS, trim: bool = False, key: str = "tender_id"
) -> DataFrame:
    """(key, part, start, text): all files by name, each below a header, in numbered parts.

    files: key, file_id, name, text.
    """
    text = tx.js_trim(F.col("text")) if trim else F.col("text")
    pieces = files.select(key, "file_id", "name", _headed(header, text).alias("text"))
    return numbered_parts(pieces, key, *_by_name(files), between, part_chars, trim_end=True)


def left_out(
    files: DataFrame, budget: int, header: tuple[str, str] = FILE_HEADER, between: str = "\n\n", min_room: int = 0, trim: bool = False, key: str = "tender_id"
) -> DataFrame:
    """(key, file_id, name, kept_chars, left_chars): a row for each file that a budget cuts or does not reach."""
    text = tx.js_trim(F.col("text")) if trim else F.col("text")
    head = F.length("name") + len(between) + len(header[0]) + len(header[1])
    sizes = files.select(key, "file_id", "name", head.cast("bigint").alias("head"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("size"))
    placed = distributed_sum(sizes, [key], *_by_name(files), F.col("head") + F.col("size"), out="start")
    room = F.lit(budget) - F.col("start") - F.col("head")
    kept = F.when(room > min_room, F.least(room, F.col("size"))).otherwise(0).cast("bigint")
    return placed.select(key, "file_id", "name", kept.alias("kept_chars"), (F.col("size") - kept).alias("left_chars")).where("left_chars > 0")


def assemble_by_budget(
    files: DataFrame,
    budget: int,
    header: tuple[str, str] = FILE_HEADER,
    cut_mark: str = CUT_BUDGET,
    between: str = "\n\n",
    min_room: int = 0,
    trim: bool = False,
    key: str = "tender_id",
    salts: int = 64,
) -> DataFrame:
    """(key, corpus, n_files): the caller's budget of characters, spent on files by name, the last one cut and marked.

    What fits is decided on lengths alone; only the chosen files meet their texts.  ``left_out`` lists the rest.
    """
    text = tx.js_trim(F.col("text")) if trim else F.col("text")
    head = F.concat(F.lit(between + header[0]), F.col("name"), F.lit(header[1]))
    sizes = files.select(key, "file_id", "name", F.length(head).alias("head"), F.length(text).alias("size"))
    chosen = within_budget(sizes, budget, min_room, key, salts).select(key, "file_id", "n", "room", "size")
    whole = files.select(key, "file_id", head.alias("header"), text.alias("text"))
    cut = F.concat(F.substring("text", F.lit(1), F.col("room").cast("int")), F.lit(cut_mark))
    body = F.when(F.col("size") > F.col("room"), cut).otherwise(F.col("text"))
    parts = chosen.join(whole, [key, "file_id"]).select(key, "n", F.concat("header", body).alias("part"))
    return parts.groupBy(key).agg(
        tx.js_trim(joined_in_order("part", "n", "")).alias("corpus"), F.count("*").alias("n_files")
    )


def plain_files(files: DataFrame) -> DataFrame:
    """Files that hold text: one not of a text kind that shows control characters at its beginning is binary."""
    start = F.substring(tx.js_trim(F.col("text")), 1, 400)
    binary = ~F.col("name").rlike(r"(?i)\.(txt|md|json)$") & start.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    return files.where(~binary & tx.non_blank(F.col("text")))


def folder_texts(files: DataFrame, part_chars: int = PART_CHARS, key: str = "folder") -> DataFrame:
    """(key, part, start, text): the plain texts of a folder by name, in numbered parts.

    Bounds, sums and parts each go over the texts; the files are read once.
    """
    texts = cut_to_table(plain_files(files).select(key, "file_id", "name", "text"), "folder-texts")
    return assemble_files(texts, FOLDER_HEADER, "\n\n", part_chars, trim=True, key=key)


def snippet_corpus(files: DataFrame, part_chars: int = PART_CHARS, key: str = "tender_id") -> DataFrame:
    """The fallback when nothing was parsed: all text files in order, those too short left out, in numbered parts."""
    rows = files.withColumn("text", tx.js_trim(F.col("text"))).where(F.length("text") > SNIPPET_MIN_CHARS)
    pieces = rows.select(key, "ord", _headed(("### Файл: ", "\n"), F.col("text")).alias("text"))
    return numbered_parts(pieces, key, ["ord"], [ordered_bucket(F.col("ord"), files)], "\n\n", part_chars)


def corpus_source(extracted: DataFrame, native: DataFrame, key: str = "tender_id") -> DataFrame:
    """Parts of the extracted text where a tender has any, else of the native one, with their ``source``.

    extracted, native: key, part, start, text.
    """
    has = extracted.where(F.length("text") > 0).select(key).distinct()
    own = extracted.withColumn("source", F.lit("extracted"))
    return own.unionByName(native.join(has, key, "left_anti").withColumn("source", F.lit("inputs_native")))


def enough_text(corpora: DataFrame, text: str = "corpus") -> DataFrame:
    """Add whether a corpus is long enough for analysis and for a card or proposal."""
    n = collapsed_length(F.col(text))
    return corpora.select(
        "*",
        n.cast("bigint").alias("collapsed_chars"),
        (n >= MIN_ANALYSIS_CHARS).alias("analysis_ok"),
        (n >= MIN_CARD_CHARS).alias("card_ok"),
    )
