"""File inventory: folder trees, per-tender counts, archive indexes, bundles and rendered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions import text as tx
from docsluice.functions.ranking import distributed_rank, ordered_bucket
from docsluice.operators.extraction import FOLDER_MIME, NATIVE_MIME_PREFIX
from docsluice.operators.parts import PART_CHARS, numbered_parts, with_ends
from docsluice.session import cut_lineage

# Folder names, markers, headings and limits.
TENDER_FOLDERS = ("inputs", "drafts", "exports", "attachments", "notes")
CUSTOMER_MARKERS = ("заказч", "требован", "извещ", "технич", "техзад")
SUBMISSION_MARKERS = ("участ", "подач", "заяв", "коммерц", "предложен")
ARCHIVE_ROOT = "_корень_архива"
CATEGORY_ORDER = {"customer": 0, "submission": 1, "ambiguous": 2, "other": 3}
CATEGORY_TITLES = {
    "customer": "### Документация заказчика (требования)",
    "submission": "### Документация для участия",
    "other": "### Прочие файлы (маркеры не сработали)",
    "ambiguous": "### Неоднозначный путь (есть маркеры и заказчика, и участия)",
}
NATIVE_DOC, NATIVE_SHEET = NATIVE_MIME_PREFIX + "document", NATIVE_MIME_PREFIX + "spreadsheet"


def folder_paths(nodes: DataFrame, root: str, max_depth: int | None = None) -> DataFrame:
    """(folder_id, path, depth) of all folders below a root.

    Paths double: every round joins each folder's known stretch with the stretch above it, so depth 30 takes five joins
    of the folder table with itself, each checkpointed.  Without a depth the rounds go on until the stretches are as
    long as there are folders.  Folders that never reach the root (or lie on a cycle) drop out.
    """
    reach = nodes.where(F.col("mime") == FOLDER_MIME).select(
        F.col("id").alias("folder_id"),
        F.when(F.col("parent_id") != root, F.col("parent_id")).alias("up"),
        F.col("name").alias("path"),
        F.lit(1).alias("depth"),
    )
    for _ in range(max(1, reach.count() if max_depth is None else max_depth).bit_length()):
        above = reach.select(
            F.col("folder_id").alias("up"),
            F.col("up").alias("up2"),
            F.col("path").alias("path2"),
            F.col("depth").alias("depth2"),
            F.lit(True).alias("found"),
        )
        joined = reach.join(above, "up", "left").where(F.col("up").isNull() | F.col("found"))
        reach = cut_lineage(
            joined.select(
                "folder_id",
                F.col("up2").alias("up"),
                F.concat_ws("/", "path2", "path").alias("path"),
                (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
            )
        )
        if reach.where(F.col("up").isNotNull()).isEmpty():
            break
    found = reach.where(F.col("up").isNull()).drop("up")
    return found if max_depth is None else found.where(F.col("depth") <= max_depth)


def tree_paths(
    nodes: DataFrame,
    root: str,
    max_depth: int | None = None,
    folders: DataFrame | None = None,
) -> DataFrame:
    """Files of a tree with their path and depth."""
    folders = folder_paths(nodes, root, max_depth) if folders is None else folders
    files = nodes.where((F.col("mime") != FOLDER_MIME) & F.col("name").isNotNull())
    top = files.where(F.col("parent_id") == root).select("*", F.col("name").alias("path"), F.lit(0).alias("depth"))
    below = files.join(folders.withColumnRenamed("folder_id", "parent_id"), "parent_id").select(
        *files.columns, F.concat("path", F.lit("/"), "name").alias("path"), "depth"
    )
    return top.unionByName(below)


def manifest_summary(nodes: DataFrame, root: str, expected: int, max_depth: int | None = None) -> DataFrame:
    """One row: all files, folders visited (the root too), and whether there are more files than a reader expects."""
    folders = folder_paths(nodes, root, max_depth)
    n_folders = folders.agg((F.count("*") + 1).alias("n")).scalar()
    n_files = tree_paths(nodes, root, max_depth, folders).agg(F.count("*").alias("n"))
    return n_files.select(
        F.col("n").alias("file_count"), n_folders.alias("folder_count"), (F.col("n") > expected).alias("over_expected")
    )


def tender_tree(nodes: DataFrame, root: str) -> DataFrame:
    """(year, tender, tender_id, sub, sub_id): tender folders in year folders or directly below the root."""
    folders = nodes.where(F.col("mime") == FOLDER_MIME).select("id", "parent_id", "name")
    top = folders.where(F.col("parent_id") == root)
    is_year = F.col("name").rlike(r"^\d{4}$")
    years = top.where(is_year).select(F.col("id").alias("parent_id"), F.col("name").alias("year"))
    in_years = folders.join(years, "parent_id").select("year", F.col("name").alias("tender"), F.col("id").alias("tender_id"))
    flat = top.where(~is_year).select(
        F.lit(None).cast("string").alias("year"), F.col("name").alias("tender"), F.col("id").alias("tender_id")
    )
    subs = folders.where(F.col("name").isin(*TENDER_FOLDERS)).select(
        F.col("parent_id").alias("tender_id"), F.col("name").alias("sub"), F.col("id").alias("sub_id")
    )
    return in_years.unionByName(flat).join(subs, "tender_id", "left")


def tender_inventory(
    files: DataFrame, tender: list[str], sub: str = "sub", folders: tuple[str, ...] = TENDER_FOLDERS
) -> DataFrame:
    """Files per tender and sub-folder, one column each."""
    return files.groupBy(*tender).pivot(sub, list(folders)).count().fillna(0, subset=list(folders))


def archive_split(path: Column) -> tuple[Column, Column]:
    """First segment of a path (the project) and the rest."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    project = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(ARCHIVE_ROOT))
    return project, F.array_join(F.slice(parts, 2, 1_000_000), "/")


def archive_category(
    path: Column, customer: tuple[str, ...] = CUSTOMER_MARKERS, submission: tuple[str, ...] = SUBMISSION_MARKERS
) -> Column:
    """customer, submission, ambiguous or other by the markers in a path below the project."""
    low = F.lower(path)

    def has(markers: tuple[str, ...]) -> Column:
        return F.exists(F.array(*map(F.lit, markers)), lambda m: low.contains(m))

    c, s = has(customer), has(submission)
    return F.when(c & s, "ambiguous").when(c, "customer").when(s, "submission").otherwise("other")


def archive_index(files: DataFrame, customer=CUSTOMER_MARKERS, submission=SUBMISSION_MARKERS) -> DataFrame:
    """(project, category, n_files) of files with a path."""
    project, under = archive_split(F.col("path"))
    rows = files.where(F.col("path") != "").select(
        project.alias("project"), archive_category(under, customer, submission).alias("category")
    )
    return rows.groupBy("project", "category").agg(F.count("*").alias("n_files"))


def archive_entries(files: DataFrame, customer=CUSTOMER_MARKERS, submission=SUBMISSION_MARKERS) -> DataFrame:
    """The rendered archive index as ordered rows, so that it is written in parallel and never gathered.

    files: id, name, mime, size, path, link.  Order: project, category_no, path in Russian order.
    """
    project, under = archive_split(F.col("path"))
    category = archive_category(under, customer, submission)
    size = F.when(F.col("size").isNotNull(), F.concat(F.lit(" · "), F.col("size").cast("string"), F.lit(" B"))).otherwise("")
    entry = F.concat(
        F.lit("- **"), F.coalesce("name", F.col("id").cast("string")), F.lit("** (`"), F.coalesce("mime", F.lit("")), F.lit("`"), size,
        F.lit(")\n  - путь: `"), "path", F.lit("`\n  - [Открыть]("), "link", F.lit(")\n"),
    )
    number = F.create_map(*[F.lit(x) for kv in CATEGORY_ORDER.items() for x in kv])
    title = F.create_map(*[F.lit(x) for kv in CATEGORY_TITLES.items() for x in kv])
    rows = files.where(F.col("path") != "").select(
        project.alias("project"), category.alias("category"), "path", entry.alias("entry")
    )
    return rows.select(
        "project", number[F.col("category")].alias("category_no"), title[F.col("category")].alias("heading"), "path", "entry"
    )


def order_names(names: Column) -> list[Column]:
    """Sort keys of names in Russian order, the raw name last."""
    return [F.collate(names, "ru"), names]


def pull_plan(files: DataFrame) -> DataFrame:
    """Target path and outcome of every file to be copied out: documents as text, sheets as CSV, other native kinds skipped."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    safe = F.transform(parts, lambda p: F.coalesce(F.nullif(tx.js_trim(F.regexp_replace(p, r'[\\/:*?"<>|]+', "_")), F.lit("")), F.lit("_")))
    target = F.array_join(safe, "/")
    mime = F.coalesce("mime", F.lit(""))
    as_text = F.when(F.lower(target).endswith(".txt"), target).otherwise(F.concat(target, F.lit(".txt")))
    skipped = mime.startswith(NATIVE_MIME_PREFIX) & ~mime.isin(NATIVE_DOC, NATIVE_SHEET)
    return files.select(
        "*",
        F.when(skipped, None)
        .when(mime == NATIVE_DOC, as_text)
        .when(mime == NATIVE_SHEET, F.concat(F.regexp_replace(target, r"\.[^\\/]+$", ""), F.lit(".csv")))
        .otherwise(target)
        .alias("target"),
        F.when(skipped, "skipped").otherwise("written").alias("outcome"),
    )


def pull_summary(plan: DataFrame, by: list[str]) -> DataFrame:
    return plan.groupBy(*by).agg(
        F.count_if(F.col("outcome") == "written").alias("written"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )


def context_target(source: Column, name: Column, mime: Column) -> Column:
    """Where a context file is copied: a folder per source, the kind's extension added; NULL if its kind has no export."""
    folder = tx.safe_name(source, 120, "context", "_")
    base = F.concat(folder, F.lit("/"), F.regexp_replace(name, r'[\\/:*?"<>|]+', "_"))
    return (
        F.when(mime == NATIVE_DOC, F.concat(base, F.lit(".txt")))
        .when(mime == NATIVE_SHEET, F.concat(base, F.lit(".csv")))
        .when(mime.startswith(NATIVE_MIME_PREFIX), None)
        .otherwise(base)
    )


def union_context(primary: DataFrame, extra: DataFrame, label: str = "context") -> DataFrame:
    """Primary files, then those of extra roots, with their group and source; nothing is removed."""
    tagged = primary.withColumns({"context_group": F.lit("primary"), "context_source": F.lit(label)})
    others = extra.withColumn("context_group", F.lit("extra"))
    return tagged.unionByName(others, allowMissingColumns=True)


def agent_bundle(lists: dict[str, DataFrame], order: dict[str, str], key: str = "tender_id") -> DataFrame:
    """(key, list, nth, …): the files of every list of a tender as numbered rows, each list in its own order.

    Lists share what columns they share; a tender's list of any length is numbered stretch by stretch.
    """
    out = None
    for name, files in lists.items():
        rows = distributed_rank(files, [key], [order[name]], [ordered_bucket(F.col(order[name]), files)], out="nth").withColumn("list", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def markdown_cell(c: Column) -> Column:
    """Text for a table cell: bars escaped, one line."""
    flat = F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"\r?\n", " ")
    return tx.js_trim(flat)


def render_rows(rows: DataFrame, key: str, header: list[str], cells: list[str], order: list[str]) -> DataFrame:
    """A Markdown table per key as ordered lines: (key, line_no_key…, line).

    Lines stay rows.  A writer partitions by key and sorts within partitions, so no table is held as one value.
    """
    bars = lambda xs: F.concat(F.lit("| "), F.concat_ws(" | ", *xs), F.lit(" |"))
    return rows.select(key, *order, bars([markdown_cell(F.col(c).cast("string")) for c in cells]).alias("line"))


def render_parts(lines: DataFrame, key: str, order: str, header: Column, part_chars: int = PART_CHARS) -> DataFrame:
    """(key, part, start, text): a header and all lines of a key, in numbered parts."""
    pieces = with_ends(lines.select(key, order, F.col("line").alias("text")), key, lines.select(key).distinct().select(key, header.alias("text")))
    return numbered_parts(pieces, key, ["_rank", order], [F.col("_rank"), ordered_bucket(F.col(order), lines)], "\n", part_chars)


def file_queue(files: DataFrame, default_url: str) -> DataFrame:
    """Queue rows whose document URL falls back to one made from the id; ``default_url`` holds ``{id}``."""
    before, after = default_url.split("{id}")
    made = F.concat(F.lit(before), F.col("id").cast("string"), F.lit(after))
    return files.select("id", "mime", "path", "link", F.coalesce("link", made).alias("document_url"))
