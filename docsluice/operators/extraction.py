"""Extraction manifest: what a file is, how far its extracted text can be trusted, and counts per run."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.functions import text as tx
from docsluice.functions.patterns import WS_CHARS

# MIME types, names, extensions, limits and hints.
FOLDER_MIME = "application/vnd.google-apps.folder"
NATIVE_MIME_PREFIX = "application/vnd.google-apps."
NATIVE_KINDS = {
    "application/vnd.google-apps.document": "google_doc",
    "application/vnd.google-apps.spreadsheet": "google_sheet",
    "application/vnd.google-apps.presentation": "google_slides",
}
MANIFEST_NAME = "extract-manifest.json"
UTF8_EXTENSIONS = (".txt", ".md", ".csv", ".log", ".json", ".xml", ".html", ".htm")
HINTS = {
    "no_text_error": "Текст не извлечён — не трать токены на повторный разбор бинарника с нуля; "
    "опирайся на другие документы или запроси файл у пользователя.",
    "no_text": "Пустой текст — содержимое для анализа отсутствует.",
    "ocr": "Текст получен через OCR — возможны искажения; важные цифры, суммы и даты сверяй с другими документами "
    "или оригиналом.",
    "warning": "Текст извлечён с предупреждением конвертера — при критичных цитатах сверяй оригинал на Drive.",
    "truncated": "Текст усечён по лимиту символов; полный объём в файле на Google Drive.",
    "utf8": "Нативный текст в inputs — обычно достоверен для цитирования.",
    "google": "Текст из экспорта Google Docs/Sheets/Slides — обычно структурно пригоден для анализа.",
    "word": "Текст из DOC/DOCX — обычно пригоден; вёрстка таблиц может отличаться от PDF.",
    "pdf": "Текст из текстового слоя PDF — обычно пригоден для цитирования.",
    "other": "Используй canonicalTextPath как единственный источник текста для этого файла; не дублируй извлечение "
    "из бинарного оригинала.",
}
QUALITY = {
    "short_chars": 48, "cyrillic_chars": 200, "cyrillic_letters": 150, "cyrillic_share": 0.38,
    "cjk_chars": 120, "cjk_letters": 100, "cjk_share": 0.018, "replacements": 4, "replacement_every": 400,
    "lines": 36, "short_line": 3, "short_line_share": 0.33, "many_lines": 60, "mean_line": 5.5,
}
MIN_PAGE_CHARS = 50
PAGE_MARK = "\f"  # fixed value: the form feed between pages of a text layer


def input_kind(mime: Column, name: Column) -> Column:
    """Kind of an input file by its MIME type, then by its name; the first rule that holds wins."""
    mime = F.lower(F.coalesce(mime, F.lit("")))
    low = F.lower(F.coalesce(name, F.lit("")))
    out = F.when(mime == FOLDER_MIME, "folder").when((low == "") | (name == MANIFEST_NAME), "skip")
    for value, kind in NATIVE_KINDS.items():
        out = out.when(mime == value, kind)
    office = mime.contains("pdf") | mime.contains("wordprocessingml") | mime.contains("msword")
    plain = mime.startswith("text/") | mime.isin("application/json", "application/xml")
    return (
        out.when(mime.startswith(NATIVE_MIME_PREFIX), "google_other")
        .when(office | low.rlike(r"\.(pdf|docx|doc)$"), "binary_office")
        .when(plain | tx.extension(low).isin(*UTF8_EXTENSIONS), "native_utf8")
        .otherwise("unknown")
    )


def needs_workspace(kind: Column) -> Column:
    """Whether a kind needs text extraction."""
    return ~kind.isin("native_utf8", "folder", "skip")


def workspace_per_tender(files: DataFrame) -> DataFrame:
    kind = input_kind(F.col("mime"), F.col("name"))
    return files.groupBy("tender_id").agg(
        F.bool_or(needs_workspace(kind)).alias("needs_workspace"), F.count("*").alias("n_files")
    )


def extraction_markup(
    mode: Column, source_name: Column, dest_name: Column, chars: Column, error: Column, extractor: Column, truncated: Column
) -> Column:
    """Struct that tells a reader where the text of a file is and how far to trust it."""
    used = tx.js_trim(F.coalesce(extractor, F.lit("")))
    ocr = used.rlike("(?i)tesseract|ocr")
    has_error = F.coalesce(tx.non_blank(error), F.lit(False))
    no_text = chars == 0
    workspace = mode == "extracted_workspace"
    path = F.when(~no_text & workspace & (dest_name != ""), F.concat(F.lit("inputs/extracted/"), dest_name)).when(
        ~no_text & (mode == "native_only"), F.concat(F.lit("inputs/"), source_name)
    )
    hint = (
        F.when(no_text & has_error, HINTS["no_text_error"])
        .when(no_text, HINTS["no_text"])
        .when(ocr, HINTS["ocr"])
        .when(has_error, HINTS["warning"])
        .when(truncated, HINTS["truncated"])
        .when(used == "utf8", HINTS["utf8"])
        .when(used.startswith("google_"), HINTS["google"])
        .when(used.isin("mammoth", "word-extractor"), HINTS["word"])
        .when(used.contains("pdf-parse"), HINTS["pdf"])
        .otherwise(HINTS["other"])
    )
    quality = (
        F.when(no_text, "failed")
        .when(has_error, "degraded")
        .when(ocr, "ocr")
        .when((F.lower(used) == "pdf-parse") & (chars < 200), "medium")
        .otherwise("high")
    )
    provenance = F.when(no_text, "none").when(workspace, "extracted_txt").otherwise("native_inputs_utf8")
    return F.struct(
        path.alias("canonical_text_path"),
        F.concat(F.lit("inputs/"), source_name).alias("source_binary_path"),
        provenance.alias("text_provenance"),
        path.isNotNull().alias("read_only_this"),
        ocr.alias("used_ocr"),
        quality.alias("quality"),
        truncated.alias("truncated"),
        (has_error & ~no_text).alias("parsing_warning"),
        hint.alias("hint"),
    )


def text_quality(c: Column) -> Column:
    """Struct of the defects of a text layer and ``needs_visual``, their disjunction."""
    return tx.let(F.coalesce(c, F.lit("")), lambda text: tx.let(_layer_measures(text), _layer_flags))


def _layer_measures(text: Column) -> Column:
    counts = tx.script_counts(text)
    sizes = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.length(tx.js_trim(x))), lambda n: n > 0)
    return F.struct(
        *[counts[n].alias(n) for n in ("cyrillic", "latin", "cjk", "replacement")],
        F.length(text).alias("chars"),
        (F.length(text) - tx.class_count(text, WS_CHARS)).alias("compact"),
        F.length(tx.collapse_ws(text)).alias("flat"),
        sizes.alias("sizes"),
    )


def _layer_flags(m: Column) -> Column:
    q = QUALITY
    letters, wide = m["cyrillic"] + m["latin"], m["cyrillic"] + m["latin"] + m["cjk"]
    garbage = (
        (m["compact"] >= q["cyrillic_chars"]) & (letters >= q["cyrillic_letters"])
        & (m["cyrillic"] / letters < q["cyrillic_share"])
    )
    replaced = (m["replacement"] >= q["replacements"]) & (m["replacement"] > m["chars"] / q["replacement_every"])
    mojibake = (
        (m["compact"] >= q["cjk_chars"]) & (wide >= q["cjk_letters"]) & ((m["cjk"] / wide > q["cjk_share"]) | replaced)
    )
    sizes = m["sizes"]
    n = F.size(sizes)
    short = F.size(F.filter(sizes, lambda x: x <= q["short_line"]))
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)
    fragmented = (n >= q["lines"]) & (
        (short / n > q["short_line_share"]) | ((n >= q["many_lines"]) & (total / n < q["mean_line"]))
    )
    flags = {
        "too_short": m["flat"] < q["short_chars"], "low_cyrillic": garbage, "mojibake": mojibake, "fragmented": fragmented
    }
    flags = {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    anything = flags["too_short"] | flags["low_cyrillic"] | flags["mojibake"] | flags["fragmented"]
    return F.struct(*[v.alias(k) for k, v in flags.items()], anything.alias("needs_visual"))


def score_layers(rows: DataFrame, text: str = "text") -> DataFrame:
    """Add the quality flags as columns; the generator keeps them from being computed once per flag."""
    return rows.select("*", F.inline(F.array(text_quality(F.col(text)))))


def split_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = PAGE_MARK) -> DataFrame:
    """(key, page, start, page_text): the pages of a text layer from 1, with where they begin in it."""
    pages = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), mark)).alias("_n", "page_text"))
    before = Window.partitionBy(key).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum((F.length("page_text") + len(mark)).cast("bigint")).over(before), F.lit(0))
    return pages.select(key, (F.col("_n") + 1).cast("bigint").alias("page"), start.alias("start"), "page_text")


def page_verdicts(pages: DataFrame, text: str = "page_text") -> DataFrame:
    """Pages with ``accepted`` (their own text layer will do) and, where not, the ``defects`` of it."""
    judged = pages.withColumn("_q", text_quality(F.col(text)))
    q = F.col("_q")
    short = F.length(tx.collapse_ws(F.col(text))) < MIN_PAGE_CHARS
    names = F.array(F.when(short, "short"), *[F.when(q[d], d) for d in ("low_cyrillic", "mojibake", "fragmented")])
    defects = F.array_join(F.filter(names, lambda d: d.isNotNull()), ",")
    return judged.select(*pages.columns, (defects == "").alias("accepted"), F.nullif(defects, F.lit("")).alias("defects"))


def document_verdicts(judged: DataFrame, key: str = "doc_id", text: str = "page_text") -> DataFrame:
    """What pages come to: counts, the stretches of pages to be read visually, and the verdict on the document.

    ``text`` takes the layer as it is, ``visual`` reads all pages anew, ``mixed`` only the stretches that were rejected.
    """
    w = Window.partitionBy(key).orderBy("page")
    opens = ~F.col("accepted") & F.coalesce(F.lag("accepted").over(w), F.lit(True))
    rows = judged.withColumn("_opens", opens)
    folded = rows.groupBy(key).agg(
        F.count("*").alias("pages"), F.count_if("accepted").alias("accepted_pages"), F.count_if("_opens").alias("stretches"),
        F.min(F.when(~F.col("accepted"), F.col("page"))).alias("first_rejected"), F.max(F.when(~F.col("accepted"), F.col("page"))).alias("last_rejected"),
        F.coalesce(F.sum(F.when(F.col("accepted"), F.length(text).cast("bigint"))), F.lit(0)).alias("kept_chars"),
    )
    verdict = F.when(F.col("accepted_pages") == F.col("pages"), "text").when(F.col("accepted_pages") == 0, "visual").otherwise("mixed")
    return folded.withColumn("verdict", verdict)


def extraction_counts(items: DataFrame) -> DataFrame:
    """Per tender: items, good ones, failed ones, those good with text, and the extractors used (a handful of names)."""
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    return items.groupBy("tender_id").agg(
        F.count("*").alias("total"),
        F.count_if(~failed).alias("ok"),
        F.count_if(failed).alias("errors"),
        F.count_if(~failed & (F.col("chars") > 0)).alias("ok_with_text"),
        F.array_join(F.array_sort(F.collect_set("extractor")), ",").alias("extractors"),
    )


def extract_texts(
    blobs: DataFrame,
    fn: Callable[[bytes, str, str], tuple[str, str | None, str | None]],
    max_chars: int | None = None,
) -> DataFrame:
    """Rows (name, mime, content) → adds text, error, extractor, kind; every row stays, folders and skipped names too.

    One pass over the contents: UTF-8 files are decoded in the JVM, only the bytes of the others go to the provider
    ``fn(bytes, name, mime)``.  A text is cut, and marked as cut, only if the caller sets a size.
    """
    @F.pandas_udf("text string, error string, extractor string")
    def ask(content: pd.Series, name: pd.Series, mime: pd.Series) -> pd.DataFrame:
        replies = [(None, None, None) if c is None else fn(c, n, m) for c, n, m in zip(content, name, mime)]
        return pd.DataFrame(replies, columns=["text", "error", "extractor"], dtype=object)

    kinds = blobs.withColumn("kind", input_kind(F.col("mime"), F.col("name")))
    utf8, asked = F.col("kind") == "native_utf8", needs_workspace(F.col("kind"))
    # One call for each content, however often its reply is used; what the JVM decodes stays there.
    replied = kinds.withColumn("_reply", ask.asNondeterministic()(F.when(asked, F.col("content")), F.col("name"), F.col("mime")))
    both = replied.select(
        *[c for c in kinds.columns if c != "content"],
        F.when(utf8, tx.js_trim(tx.decode_utf8(F.col("content")))).otherwise(F.col("_reply.text")).alias("text"),
        F.col("_reply.error").alias("error"),
        F.when(utf8, "utf8").otherwise(F.col("_reply.extractor")).alias("extractor"),
    )
    empty = F.coalesce(F.col("text") == "", F.lit(True))
    text, truncated = F.col("text"), F.lit(False)
    if max_chars is not None:
        text, truncated = tx.truncate_marked(text, max_chars, f"\n\n…[усечено {max_chars} симв.]"), F.length("text") > max_chars
    return both.select(
        *[c for c in both.columns if c not in ("text", "error")],
        text.alias("text"),
        F.coalesce(truncated, F.lit(False)).alias("truncated"),
        F.when(empty, F.coalesce("error", F.lit("пустой текст"))).alias("error"),
    )


def merge_state(old: DataFrame, patch: DataFrame, key: str = "tender_id") -> DataFrame:
    """Shallow merge: fields present in the patch replace, the others stay.

    Both sides hold one row per key, so the join stays one to one.
    """
    columns = [c for c in dict.fromkeys([*old.columns, *patch.columns]) if c != key]

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(key, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != key])

    joined = side(old, "_old_").join(side(patch, "_new_"), key, "full")

    def merged(c: str) -> Column:
        sides = [f"_new_{c}"] * (c in patch.columns) + [f"_old_{c}"] * (c in old.columns)
        return F.coalesce(*sides).alias(c)

    return joined.select(key, *[merged(c) for c in columns])


def state_items(states: DataFrame, json: str = "json", key: str = "tender_id") -> DataFrame:
    """Pipeline states as JSON → one row per parsed item; a state that is no object, or has no items, gives none."""
    items = F.try_variant_get(F.try_parse_json(json), "$.parsing.items", "array<variant>")
    rows = states.select(key, F.posexplode(items).alias("ord", "item"))

    def text(path: str) -> Column:
        return F.try_variant_get("item", f"$.{path}", "string")

    return rows.select(
        key,
        "ord",
        text("name").alias("name"),
        text("status").alias("status"),
        text("ai.canonicalTextPath").alias("path"),
        F.try_variant_get("item", "$.chars", "bigint").alias("chars"),
        text("error").alias("error"),
        text("usedExtractor").alias("extractor"),
    )
