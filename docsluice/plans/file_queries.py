"""Queries of extraction manifests, file trees, inventories and ingest plans."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions import text as tx
from docsluice.functions.ranking import ordered_bucket
from docsluice.operators import extraction as ex
from docsluice.operators import ingest, inventory, picks
from docsluice.plans.registry import Tables, query, sql_collapse
from docsluice.session import shared_folder
from docsluice.sources import readers, sinks

# Files named after documents: length picks the extension, language and source the MIME type.
_SQL_NAME = """doc_id || CASE WHEN n_chars < 300 THEN '.pdf' WHEN n_chars < 600 THEN '.docx' WHEN n_chars < 900 THEN '.DOC'
  WHEN n_chars < 2000 THEN '.txt' WHEN n_chars < 3000 THEN '.HTML' ELSE '.bin' END"""
_SQL_MIME = """CASE WHEN lang = 'fr' THEN CASE WHEN n_chars < 500 THEN 'application/vnd.google-apps.folder' WHEN n_chars < 1000 THEN 'application/vnd.google-apps.document'
  WHEN n_chars < 2000 THEN 'application/vnd.google-apps.spreadsheet' WHEN n_chars < 3000 THEN 'application/vnd.google-apps.presentation'
  ELSE 'application/vnd.google-apps.form' END WHEN lang = 'es' AND n_chars > 3000 THEN 'text/x-log' ELSE '' END"""


def _steps(column: Column, steps: list[tuple[int, str]], last: str) -> Column:
    out = None
    for limit, value in steps:
        out = F.when(column < limit, value) if out is None else out.when(column < limit, value)
    return out.otherwise(last)


def named_files(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    ext = _steps(n, [(300, ".pdf"), (600, ".docx"), (900, ".DOC"), (2000, ".txt"), (3000, ".HTML")], ".bin")
    p = ex.NATIVE_MIME_PREFIX
    native = _steps(n, [(500, p + "folder"), (1000, p + "document"), (2000, p + "spreadsheet"), (3000, p + "presentation")], p + "form")
    mime = F.when(F.col("lang") == "fr", native).when((F.col("lang") == "es") & (n > 3000), "text/x-log").otherwise("")
    return t.documents.select(
        "doc_id", F.col("source").alias("tender_id"), "n_chars", F.concat(F.col("doc_id").cast("string"), ext).alias("name"), mime.alias("mime")
    )


_SQL_FILES = f"SELECT doc_id, source AS tender_id, n_chars, {_SQL_NAME} AS name, {_SQL_MIME} AS mime FROM documents"
_SQL_KIND = f"""
SELECT *, CASE WHEN mime LIKE '%.folder' THEN 'folder' WHEN mime LIKE '%apps.document' THEN 'google_doc'
  WHEN mime LIKE '%.spreadsheet' THEN 'google_sheet' WHEN mime LIKE '%.presentation' THEN 'google_slides'
  WHEN mime LIKE 'application/vnd.google-apps.%' THEN 'google_other'
  WHEN lower(name) SIMILAR TO '.*\\.(pdf|docx|doc)' THEN 'binary_office'
  WHEN mime LIKE 'text/%' OR lower(name) SIMILAR TO '.*\\.(txt|md|csv|log|json|xml|html|htm)' THEN 'native_utf8'
  ELSE 'unknown' END AS kind FROM ({_SQL_FILES})"""


@query("classify_input_kind", f"SELECT doc_id, name, mime, kind FROM ({_SQL_KIND})")
def _kind(t: Tables) -> DataFrame:
    return named_files(t).select("doc_id", "name", "mime", ex.input_kind(F.col("mime"), F.col("name")).alias("kind"))


@query(
    "needs_workspace",
    f"SELECT tender_id, bool_or(kind NOT IN ('native_utf8', 'folder', 'skip')) AS needs_workspace, count(*) AS n_files FROM ({_SQL_KIND}) GROUP BY 1",
)
def _workspace(t: Tables) -> DataFrame:
    return ex.workspace_per_tender(named_files(t))


def _markup_items(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    q, n = F.col("quality"), F.col("n_chars")
    return rows.select(
        "doc_id",
        F.col("source").alias("tender_id"),
        F.when(F.col("lang") == "en", "native_only").otherwise("extracted_workspace").alias("mode"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"),
        F.concat(F.lit("extract-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("dest"),
        F.when(n < 200, 0).otherwise(F.when(F.col("lang") == "es", F.floor(n / 10)).otherwise(n)).cast("bigint").alias("chars"),
        F.when(q == 0, "boom").otherwise("").alias("error"),
        F.when(F.col("toxic") == 1, "tesseract").when(F.col("lang") == "en", "utf8").when(F.col("lang") == "fr", "google_export")
        .when(F.col("lang") == "de", "mammoth").otherwise("pdf-parse").alias("extractor"),
        (n > 5000).alias("truncated"),
    )


_SQL_MARKUP_ITEMS = """
SELECT doc_id, source AS tender_id, CASE WHEN lang = 'en' THEN 'native_only' ELSE 'extracted_workspace' END AS mode, doc_id || '.pdf' AS name,
  'extract-' || doc_id || '.txt' AS dest, CAST(CASE WHEN n_chars < 200 THEN 0 WHEN lang = 'es' THEN n_chars // 10 ELSE n_chars END AS BIGINT) AS chars,
  CASE WHEN quality = 0 THEN 'boom' ELSE '' END AS error,
  CASE WHEN toxic = 1 THEN 'tesseract' WHEN lang = 'en' THEN 'utf8' WHEN lang = 'fr' THEN 'google_export' WHEN lang = 'de' THEN 'mammoth' ELSE 'pdf-parse' END AS extractor,
  n_chars > 5000 AS truncated
FROM documents LEFT JOIN labels USING (doc_id)"""


@query(
    "extraction_markup",
    f"""
SELECT doc_id, CASE WHEN chars = 0 THEN 'failed' WHEN error <> '' THEN 'degraded' WHEN extractor = 'tesseract' THEN 'ocr'
    WHEN extractor = 'pdf-parse' AND chars < 200 THEN 'medium' ELSE 'high' END AS quality,
  CASE WHEN chars = 0 THEN 'none' WHEN mode = 'native_only' THEN 'native_inputs_utf8' ELSE 'extracted_txt' END AS text_provenance,
  CASE WHEN chars > 0 THEN CASE WHEN mode = 'native_only' THEN 'inputs/' || name ELSE 'inputs/extracted/' || dest END END AS canonical_text_path,
  chars > 0 AS read_only_this, extractor = 'tesseract' AS used_ocr, error <> '' AND chars > 0 AS parsing_warning,
  CASE WHEN chars = 0 AND error <> '' THEN '{ex.HINTS["no_text_error"]}' WHEN chars = 0 THEN '{ex.HINTS["no_text"]}'
    WHEN extractor = 'tesseract' THEN '{ex.HINTS["ocr"]}' WHEN error <> '' THEN '{ex.HINTS["warning"]}' WHEN truncated THEN '{ex.HINTS["truncated"]}'
    WHEN extractor = 'utf8' THEN '{ex.HINTS["utf8"]}' WHEN extractor = 'google_export' THEN '{ex.HINTS["google"]}'
    WHEN extractor = 'mammoth' THEN '{ex.HINTS["word"]}' ELSE '{ex.HINTS["pdf"]}' END AS hint
FROM ({_SQL_MARKUP_ITEMS})
""",
)
def _markup(t: Tables) -> DataFrame:
    columns = [F.col(c) for c in ("mode", "name", "dest", "chars", "error", "extractor", "truncated")]
    marked = _markup_items(t).select("doc_id", ex.extraction_markup(*columns).alias("m"))
    fields = ("quality", "text_provenance", "canonical_text_path", "read_only_this", "used_ocr", "parsing_warning", "hint")
    return marked.select("doc_id", *[f"m.{f}" for f in fields])


@query(
    "extraction_counts",
    f"""
SELECT tender_id, count(*) AS total, count(*) FILTER (WHERE error = '') AS ok, count(*) FILTER (WHERE error <> '') AS errors,
  count(*) FILTER (WHERE error = '' AND chars > 0) AS ok_with_text, array_to_string(list_sort(list(DISTINCT extractor)), ',') AS extractors
FROM ({_SQL_MARKUP_ITEMS}) GROUP BY 1
""",
)
def _counts(t: Tables) -> DataFrame:
    return ex.extraction_counts(_markup_items(t))


# Texts whose quality differs: some lose their spaces to line breaks, some get foreign or replacement characters.
_SQL_LAYER = """CASE WHEN lang = 'de' THEN replace(text, ' ', chr(10)) WHEN lang = 'es' THEN replace(text, 'c', chr(22909)) WHEN lang = 'fr' AND n_chars < 1500 THEN replace(text, 'e', chr(65533))
  WHEN lang = 'fr' THEN translate(text, 'aeiou', 'аеиоу') ELSE text END"""


def text_layer() -> Column:
    lang, text = F.col("lang"), F.col("text")
    return (
        F.when(lang == "de", F.replace(text, F.lit(" "), F.lit("\n")))
        .when(lang == "es", F.replace(text, F.lit("c"), F.lit(chr(22909))))
        .when((lang == "fr") & (F.col("n_chars") < 1500), F.replace(text, F.lit("e"), F.lit(chr(65533))))
        .when(lang == "fr", F.translate(text, "aeiou", "аеиоу"))
        .otherwise(text)
    )


_SQL_SCRIPTS = f"""
SELECT doc_id, t, length(t) AS n, length(regexp_replace(t, '[^\\x{{0400}}-\\x{{04FF}}]+', '', 'g')) AS cyr,
  length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS lat,
  length(regexp_replace(t, '[^\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7AF}}\\x{{FF00}}-\\x{{FFE6}}]+', '', 'g')) AS cjk,
  length(regexp_replace(t, '[^\\x{{FFFD}}]+', '', 'g')) AS repl, length(regexp_replace(t, '\\s+', '', 'g')) AS compact,
  length({sql_collapse('t')}) AS flat,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: length(trim(x))), lambda x: x > 0) AS sizes
FROM (SELECT doc_id, {_SQL_LAYER} AS t FROM documents)"""


@query(
    "text_quality",
    f"""
SELECT *, too_short OR low_cyrillic OR mojibake OR fragmented AS needs_visual FROM (
  SELECT doc_id, flat < 48 AS too_short, compact >= 200 AND cyr + lat >= 150 AND cyr / (cyr + lat) < 0.38 AS low_cyrillic,
    compact >= 120 AND cyr + lat + cjk >= 100 AND (cjk / (cyr + lat + cjk) > 0.018 OR (repl >= 4 AND repl > n / 400)) AS mojibake,
    len(sizes) >= 36 AND (len(list_filter(sizes, lambda x: x <= 3)) / len(sizes) > 0.33 OR (len(sizes) >= 60 AND list_sum(sizes) / len(sizes) < 5.5)) AS fragmented
  FROM ({_SQL_SCRIPTS}))
""",
)
def _quality(t: Tables) -> DataFrame:
    rows = t.spread("documents", "doc_id", "lang", "n_chars", "text")
    return ex.score_layers(rows.select("doc_id", text_layer().alias("layer")), "layer").drop("layer")


_SQL_PAGES = f"""
SELECT doc_id, page, start, t, accepted, CASE WHEN NOT accepted THEN concat_ws(',', CASE WHEN short THEN 'short' END, CASE WHEN low THEN 'low_cyrillic' END, CASE WHEN moji THEN 'mojibake' END, CASE WHEN frag THEN 'fragmented' END) END AS defects
FROM (SELECT *, NOT (short OR low OR moji OR frag) AS accepted FROM (
  SELECT doc_id, page, start, t, flat < 50 AS short, compact >= 200 AND cyr + lat >= 150 AND cyr / (cyr + lat) < 0.38 AS low,
    compact >= 120 AND cyr + lat + cjk >= 100 AND (cjk / (cyr + lat + cjk) > 0.018 OR (repl >= 4 AND repl > n / 400)) AS moji,
    len(sizes) >= 36 AND (len(list_filter(sizes, lambda x: x <= 3)) / len(sizes) > 0.33 OR (len(sizes) >= 60 AND list_sum(sizes) / len(sizes) < 5.5)) AS frag
  FROM ({_SQL_SCRIPTS.replace("SELECT doc_id, t,", "SELECT doc_id, page, start, t,").rsplit("FROM (", 1)[0]} FROM (
    SELECT doc_id, page, p AS t, coalesce(sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (
      SELECT doc_id, unnest(string_split(l, chr(12))) AS p, unnest(range(1, len(string_split(l, chr(12))) + 1)) AS page
      FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN replace(replace(t, '. ', chr(12)), ' ', chr(10)) ELSE replace(t, chr(10), chr(12)) END AS l FROM (
        SELECT doc_id, lang, CASE WHEN lang = 'es' THEN replace(text, 'c', chr(22909)) WHEN lang = 'fr' AND n_chars < 1500 THEN replace(text, 'e', chr(65533))
          WHEN lang = 'fr' THEN translate(text, 'aeiou', 'аеиоу') WHEN lang = 'en' THEN translate(text, 'aeionrst', 'аеионрст') ELSE text END AS t FROM documents)))))))"""


def page_layers(t: Tables) -> DataFrame:
    """Layers of several pages: a line is a page, German ones have a sentence on a page and a word on a line."""
    lang, text = F.col("lang"), F.col("text")
    layer = (
        F.when(lang == "es", F.replace(text, F.lit("c"), F.lit(chr(22909)))).when((lang == "fr") & (F.col("n_chars") < 1500), F.replace(text, F.lit("e"), F.lit(chr(65533))))
        .when(lang == "fr", F.translate(text, "aeiou", "аеиоу")).when(lang == "en", F.translate(text, "aeionrst", "аеионрст")).otherwise(text)
    )
    pages = F.when(lang == "de", F.translate(F.replace(layer, F.lit(". "), F.lit("\f")), " ", "\n")).otherwise(F.translate(layer, "\n", "\f"))
    return t.spread("documents", "doc_id", "lang", "n_chars", "text").select("doc_id", pages.alias("text"))


@query("page_quality", f"SELECT doc_id, page, start, accepted, defects FROM ({_SQL_PAGES})")
def _page_quality(t: Tables) -> DataFrame:
    return ex.page_verdicts(ex.split_pages(page_layers(t))).drop("page_text")


@query(
    "document_quality",
    f"""
SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE accepted) AS accepted_pages, count(*) FILTER (WHERE NOT accepted AND coalesce(before, true)) AS stretches,
  min(page) FILTER (WHERE NOT accepted) AS first_rejected, max(page) FILTER (WHERE NOT accepted) AS last_rejected, CAST(coalesce(sum(length(t)) FILTER (WHERE accepted), 0) AS BIGINT) AS kept_chars,
  CASE WHEN bool_and(accepted) THEN 'text' WHEN NOT bool_or(accepted) THEN 'visual' ELSE 'mixed' END AS verdict
FROM (SELECT *, lag(accepted) OVER (PARTITION BY doc_id ORDER BY page) AS before FROM ({_SQL_PAGES})) GROUP BY 1
""",
)
def _document_quality(t: Tables) -> DataFrame:
    return ex.document_verdicts(ex.page_verdicts(ex.split_pages(page_layers(t))))


@query(
    "script_class_counts",
    f"""
SELECT lang, CAST(sum(cyr) AS BIGINT) AS cyrillic, CAST(sum(lat) AS BIGINT) AS latin, CAST(sum(cjk) AS BIGINT) AS cjk, CAST(sum(repl) AS BIGINT) AS replacement
FROM ({_SQL_SCRIPTS}) JOIN documents USING (doc_id) GROUP BY 1
""",
)
def _scripts(t: Tables) -> DataFrame:
    rows = t.spread("documents", "lang", "n_chars", "text")
    counts = rows.select("lang", tx.script_counts(text_layer()).alias("c"))
    return counts.groupBy("lang").agg(*[F.sum(f"c.{n}").alias(n) for n in ("cyrillic", "latin", "cjk", "replacement")])


@query(
    "upsert_pipeline_state",
    """
SELECT coalesce(a.k, b.k) AS tender_id, coalesce(b.status, a.status) AS status, a.price AS price, b.day AS day
FROM (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_totalprice < 300000) a
FULL JOIN (SELECT o_orderkey AS k, nullif(o_orderpriority, '5-LOW') AS status, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_totalprice > 200000) b USING (k)
""",
)
def _upsert(t: Tables) -> DataFrame:
    """Two versions of a state table in the shared folder; a third is interrupted, and the second is sent once more."""
    path = f"{shared_folder(t.spark)}/states-{uuid.uuid4().hex}"
    none = lambda kind: F.lit(None).cast(kind)
    old = t.orders.where("o_totalprice < 300000").select(
        F.col("o_orderkey").alias("tender_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), none("string").alias("day")
    )
    patch = t.orders.where("o_totalprice > 200000").select(
        F.col("o_orderkey").alias("tender_id"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("status"), none("double").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )
    sinks.upsert_state(old, path, token="first")
    sinks.upsert_state(patch, path, token="second")
    sinks.upsert_state(old.withColumn("status", F.lit("lost")), path, publish=False)
    sinks.upsert_state(patch.withColumn("status", F.lit("twice")), path, token="second")
    return readers.read_latest(t.spark, path, old.schema)


_SQL_FIRST_AND_LAST = """
SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN max(o_orderkey) ELSE min(o_orderkey) END AS o_orderkey, count(*) AS n_orders FROM orders GROUP BY 1"""


@query("replace_latest", _SQL_FIRST_AND_LAST)
def _replace(t: Tables) -> DataFrame:
    """Every customer's first order as a version, then the last one of even customers; a third change is interrupted."""
    path = f"{shared_folder(t.spark)}/latest-{uuid.uuid4().hex}"
    rows = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.count("*").alias("n_orders"))
    firsts = rows.select("o_custkey", F.col("first").alias("o_orderkey"), "n_orders")
    lasts = rows.where("o_custkey % 2 = 0").select("o_custkey", F.col("last").alias("o_orderkey"), "n_orders")
    sinks.publish_latest(firsts, path, ["o_custkey"])
    sinks.publish_latest(lasts, path, ["o_custkey"])
    sinks.publish_latest(firsts.withColumn("n_orders", F.lit(0).cast("bigint")), path, ["o_custkey"], publish=False)
    return readers.read_latest(t.spark, path, firsts.schema)


@query(
    "read_pipeline_state",
    """
SELECT doc_id AS tender_id, o.ord::BIGINT AS ord, CASE WHEN o.ord = 0 THEN source ELSE lang END AS name,
  CASE WHEN o.ord = 0 THEN 'ok' ELSE 'error' END AS status, CASE WHEN o.ord = 0 THEN n_chars END AS chars
FROM documents, (SELECT unnest([0, 1]) AS ord) o WHERE lang <> 'de'
""",
)
def _state(t: Tables) -> DataFrame:
    """States as JSON text; German ones are an array instead of an object and hold nothing."""
    json = F.when(F.col("lang") == "de", F.lit("[1]")).otherwise(
        F.concat(
            F.lit('{"parsing":{"items":[{"name":"'), "source", F.lit('","status":"ok","chars":'), F.col("n_chars").cast("string"),
            F.lit('},{"name":"'), "lang", F.lit('","status":"error"}]}}'),
        )
    )
    items = ex.state_items(t.documents.select(F.col("doc_id").alias("tender_id"), json.alias("json")))
    return items.select("tender_id", F.col("ord").cast("bigint").alias("ord"), "name", "status", "chars")


# Trees: region → nation → customers and suppliers as files.
def tree_nodes(t: Tables) -> DataFrame:
    def nodes(df: DataFrame, id_: Column, parent: Column, name: str, folder: bool) -> DataFrame:
        mime = inventory.FOLDER_MIME if folder else "text/plain"
        return df.select(id_.alias("id"), parent.alias("parent_id"), F.col(name).alias("name"), F.lit(mime).alias("mime"))

    def key(prefix: str, column: str) -> Column:
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    return (
        nodes(t.region, key("r", "r_regionkey"), F.lit("root"), "r_name", True)
        .unionByName(nodes(t.nation, key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name", True))
        .unionByName(nodes(t.customer, key("c", "c_custkey"), key("n", "c_nationkey"), "c_name", False))
        .unionByName(nodes(t.supplier, key("s", "s_suppkey"), key("n", "s_nationkey"), "s_name", False))
    )


@query(
    "tree_paths",
    """
SELECT 'c' || c_custkey AS id, r_name || '/' || n_name || '/' || c_name AS path, 2::BIGINT AS depth
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 's' || s_suppkey, r_name || '/' || n_name || '/' || s_name, 2
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
)
def _tree(t: Tables) -> DataFrame:
    found = inventory.tree_paths(tree_nodes(t), "root")
    return found.select("id", "path", F.col("depth").cast("bigint").alias("depth"))


@query(
    "manifest_summary",
    """
SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS file_count,
  (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + 1 AS folder_count,
  (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) > 1000 AS over_expected
""",
)
def _summary(t: Tables) -> DataFrame:
    out = inventory.manifest_summary(tree_nodes(t), "root", expected=1000)
    return out.withColumn("file_count", F.col("file_count").cast("bigint"))


@query("read_file_tree", "SELECT 'r' || n_regionkey AS parent_id, 'n' || n_nationkey AS id, n_name AS name FROM nation")
def _children(t: Tables) -> DataFrame:
    nodes = tree_nodes(t)
    return nodes.where(F.col("parent_id").startswith("r") & (F.col("parent_id") != "root")).select("parent_id", "id", "name")


_SUB_SQL = "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'inputs' WHEN '2' THEN 'drafts' WHEN '3' THEN 'exports' WHEN '4' THEN 'attachments' ELSE 'notes' END"


def _sub_folder() -> Column:
    first = F.substring("o_orderpriority", 1, 1)
    return (
        F.when(first == "1", "inputs").when(first == "2", "drafts").when(first == "3", "exports")
        .when(first == "4", "attachments").otherwise("notes")
    )


@query(
    "tender_tree",
    f"""
SELECT DISTINCT strftime(o_orderdate, '%Y') AS year, 'T' || o_custkey AS tender, {_SUB_SQL} AS sub FROM orders
UNION ALL SELECT NULL, r_name, NULL FROM region
""",
)
def _tender_tree(t: Tables) -> DataFrame:
    """Orders as folders: year / customer / sub-folder; regions are tenders directly below the root."""
    year = F.date_format("o_orderdate", "yyyy")
    rows = t.orders.select(year.alias("y"), F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("c"), _sub_folder().alias("s"))
    folder = F.lit(inventory.FOLDER_MIME).alias("mime")
    years = rows.select(F.col("y").alias("id"), F.lit("root").alias("parent_id"), F.col("y").alias("name"), folder).distinct()
    tenders = rows.select(F.concat_ws("/", "y", "c").alias("id"), F.col("y").alias("parent_id"), F.col("c").alias("name"), folder).distinct()
    subs = rows.select(
        F.concat_ws("/", "y", "c", "s").alias("id"), F.concat_ws("/", "y", "c").alias("parent_id"), F.col("s").alias("name"), folder
    ).distinct()
    flat = t.region.select(F.col("r_name").alias("id"), F.lit("root").alias("parent_id"), F.col("r_name").alias("name"), folder)
    nodes = years.unionByName(tenders).unionByName(subs).unionByName(flat)
    return inventory.tender_tree(nodes, "root").select("year", "tender", "sub")


@query(
    "tender_inventory",
    "SELECT year, tender, " + ", ".join(f"count(*) FILTER (WHERE sub = '{s}') AS {s}" for s in inventory.TENDER_FOLDERS)
    + f" FROM (SELECT strftime(o_orderdate, '%Y') AS year, o_custkey AS tender, {_SUB_SQL} AS sub FROM orders) GROUP BY 1, 2",
)
def _inventory(t: Tables) -> DataFrame:
    files = t.orders.select(F.date_format("o_orderdate", "yyyy").alias("year"), F.col("o_custkey").alias("tender"), _sub_folder().alias("sub"))
    return inventory.tender_inventory(files, ["year", "tender"])


# Archive: page addresses as paths, with markers that occur in them.
_CUSTOMER, _SUBMISSION = ("page=", "html"), ("utm", "ref=", "/fr/")


def archive_files(t: Tables) -> DataFrame:
    path = F.regexp_replace("url", r"^https?://", "")
    return t.pages.select(
        F.col("page_id").alias("id"), path.alias("path"), F.regexp_extract("url", r"([^/]*)$", 1).alias("name"),
        F.lit("text/html").alias("mime"), F.length("html").alias("size"), F.col("url").alias("link"),
    )


_SQL_ARCHIVE = """
SELECT *, CASE WHEN c AND s THEN 'ambiguous' WHEN c THEN 'customer' WHEN s THEN 'submission' ELSE 'other' END AS category FROM (
  SELECT *, contains(under, 'page=') OR contains(under, 'html') AS c, contains(under, 'utm') OR contains(under, 'ref=') OR contains(under, '/fr/') AS s FROM (
    SELECT *, parts[1] AS project, lower(array_to_string(parts[2:], '/')) AS under FROM (
      SELECT page_id, html, url, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts
      FROM (SELECT *, regexp_replace(url, '^https?://', '') AS path FROM pages))))"""


@query("archive_category", f"SELECT page_id AS id, project, category FROM ({_SQL_ARCHIVE})")
def _category(t: Tables) -> DataFrame:
    project, under = inventory.archive_split(F.col("path"))
    return archive_files(t).select("id", project.alias("project"), inventory.archive_category(under, _CUSTOMER, _SUBMISSION).alias("category"))


@query("archive_index", f"SELECT project, category, count(*) AS n_files FROM ({_SQL_ARCHIVE}) GROUP BY 1, 2")
def _archive_index(t: Tables) -> DataFrame:
    return inventory.archive_index(archive_files(t), _CUSTOMER, _SUBMISSION)


@query(
    "archive_entries",
    f"""
SELECT project, CASE category WHEN 'customer' THEN 0 WHEN 'submission' THEN 1 WHEN 'ambiguous' THEN 2 ELSE 3 END AS category_no, path,
  CASE category WHEN 'customer' THEN '{inventory.CATEGORY_TITLES["customer"]}' WHEN 'submission' THEN '{inventory.CATEGORY_TITLES["submission"]}'
    WHEN 'ambiguous' THEN '{inventory.CATEGORY_TITLES["ambiguous"]}' ELSE '{inventory.CATEGORY_TITLES["other"]}' END AS heading,
  '- **' || regexp_extract(url, '([^/]*)$', 1) || '** (`text/html` · ' || length(html) || ' B)' || chr(10) || '  - путь: `' || path || '`' || chr(10)
    || '  - [Открыть](' || url || ')' || chr(10) AS entry FROM ({_SQL_ARCHIVE})
""",
)
def _archive_entries(t: Tables) -> DataFrame:
    return inventory.archive_entries(archive_files(t), _CUSTOMER, _SUBMISSION)


@query(
    "order_names_ru",
    "SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_name, p_partkey) AS n FROM part",
)
def _order_names(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand", "p_size").orderBy(*inventory.order_names(F.col("p_name")), "p_partkey")
    return t.part.select("p_partkey", "p_name", F.row_number().over(w).cast("bigint").alias("n"))


@query(
    "write_file_queue",
    """
SELECT page_id AS id, CASE WHEN url LIKE 'https:%' THEN url END AS link,
  coalesce(CASE WHEN url LIKE 'https:%' THEN url END, 'https://files.example.org/d/' || page_id || '/view') AS document_url FROM pages
""",
)
def _queue(t: Tables) -> DataFrame:
    files = archive_files(t).withColumn("link", F.when(F.col("link").startswith("https:"), F.col("link")))
    queue = inventory.file_queue(files, "https://files.example.org/d/{id}/view")
    path = f"{shared_folder(t.spark)}/queue-{uuid.uuid4().hex}"
    sinks.write_file_queue(queue, path)
    return t.spark.read.schema(queue.schema).json(path).select("id", "link", "document_url")


_SQL_PULL = f"""
SELECT tender_id, doc_id, CASE WHEN mime LIKE 'application/vnd.google-apps.%' AND mime NOT LIKE '%apps.document' AND mime NOT LIKE '%.spreadsheet' THEN NULL
    WHEN mime LIKE '%apps.document' THEN CASE WHEN lower(p) LIKE '%.txt' THEN p ELSE p || '.txt' END WHEN mime LIKE '%.spreadsheet' THEN regexp_replace(p, '\\.[^./]+$', '') || '.csv' ELSE p END AS target
FROM (SELECT *, tender_id || '/' || name AS p FROM ({_SQL_FILES}) WHERE mime NOT LIKE '%.folder')"""


def _pull(t: Tables) -> DataFrame:
    files = named_files(t).where(F.col("mime") != inventory.FOLDER_MIME)
    return inventory.pull_plan(files.withColumn("path", F.concat_ws("//", "tender_id", "name")))


@query("pull_plan", f"SELECT doc_id, target, CASE WHEN target IS NULL THEN 'skipped' ELSE 'written' END AS outcome FROM ({_SQL_PULL})")
def _pull_plan(t: Tables) -> DataFrame:
    return _pull(t).select("doc_id", "target", "outcome")


@query(
    "pull_summary",
    f"SELECT tender_id, count(target) AS written, count(*) - count(target) AS skipped, 0::BIGINT AS failed FROM ({_SQL_PULL}) GROUP BY 1",
)
def _pull_summary(t: Tables) -> DataFrame:
    return inventory.pull_summary(_pull(t), ["tender_id"])


_SQL_CONTEXT = f"""
SELECT doc_id, tender_id, CASE WHEN mime LIKE '%apps.document' THEN b || '.txt' WHEN mime LIKE '%.spreadsheet' THEN b || '.csv' WHEN mime LIKE 'application/vnd.google-apps.%' THEN NULL ELSE b END AS target
FROM (SELECT *, tender_id || '/' || name AS b FROM ({_SQL_FILES}))"""


@query("context_pull", f"SELECT tender_id, count(target) AS written, count(*) - count(target) AS skipped, count(DISTINCT target) AS targets FROM ({_SQL_CONTEXT}) GROUP BY 1")
def _context_pull(t: Tables) -> DataFrame:
    """Context files by their source's folder, those of a kind without an export left out."""
    files = named_files(t).withColumn("target", inventory.context_target(F.col("tender_id"), F.col("name"), F.col("mime")))
    return files.groupBy("tender_id").agg(F.count("target").alias("written"), F.count_if(F.col("target").isNull()).alias("skipped"), F.countDistinct("target").alias("targets"))


@query(
    "union_context",
    """
SELECT c_custkey AS id, c_name AS name, 'primary' AS context_group, 'context' AS context_source FROM customer
UNION ALL SELECT s_suppkey, s_name, 'extra', 'n' || s_nationkey FROM supplier
""",
)
def _context(t: Tables) -> DataFrame:
    primary = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    extra = t.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("context_source")
    )
    return inventory.union_context(primary, extra)


@query(
    "render_markdown",
    """
WITH lines AS (
  SELECT n_name, -1 AS s_suppkey, '# ' || n_name AS line FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
  UNION ALL SELECT n_name, s_suppkey, '| ' || s_name || ' | a\\|b ' || n_name || ' |' FROM supplier JOIN nation ON s_nationkey = n_nationkey),
whole AS (SELECT n_name, string_agg(line, chr(10) ORDER BY s_suppkey) AS w FROM lines GROUP BY 1)
SELECT n_name, i AS part, i * 200 AS start, substring(w, CAST(i * 200 + 1 AS BIGINT), 200) AS text FROM (SELECT *, unnest(range(0, (length(w) - 1) // 200 + 1)) AS i FROM whole)
""",
)
def _render(t: Tables) -> DataFrame:
    """Small parts, so that tables of a few lines have several."""
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("note", F.concat(F.lit("a|b\n"), "n_name"))
    lines = inventory.render_rows(rows, "n_name", ["supplier", "note"], ["s_name", "note"], ["s_suppkey"])
    return inventory.render_parts(lines, "n_name", "s_suppkey", F.concat(F.lit("# "), "n_name"), part_chars=200)


# Ingest plans.
_SQL_VARIANT = "lang || CASE WHEN n_chars > 1500 THEN '-' || substring(CAST(n_chars AS VARCHAR), 1, 2) ELSE '' END || CASE WHEN n_chars > 4000 THEN '.pdf' ELSE '.txt' END"


def variant_files(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    name = F.concat(
        "lang", F.when(n > 1500, F.concat(F.lit("-"), F.substring(n.cast("string"), 1, 2))).otherwise(""),
        F.when(n > 4000, ".pdf").otherwise(".txt"),
    )
    return t.documents.select(
        F.col("source").alias("folder"), name.alias("name"), F.floor(n / 1000).alias("size"), F.floor(F.col("doc_id") / 100).alias("mtime"), F.col("doc_id").alias("ord")
    )


_SQL_PICKS = f"""
SELECT folder, dest_name, arg_max(name, (size, mtime, -ord)) AS source_name, count(*) AS n_variants FROM (
  SELECT *, regexp_replace(name, '^(.*)-\\d{{1,3}}(\\.[^./]+)$', '\\1\\2') AS dest_name FROM (
    SELECT source AS folder, {_SQL_VARIANT} AS name, n_chars // 1000 AS size, doc_id // 100 AS mtime, doc_id AS ord FROM documents)) GROUP BY 1, 2"""


@query("canonical_pick", _SQL_PICKS)
def _canonical(t: Tables) -> DataFrame:
    return ingest.canonical_pick(variant_files(t))


@query(
    "omitted_variants",
    f"""
SELECT f.folder, f.name, 'duplicate_local_variant' AS reason FROM (
  SELECT source AS folder, {_SQL_VARIANT} AS name, regexp_replace({_SQL_VARIANT}, '^(.*)-\\d{{1,3}}(\\.[^./]+)$', '\\1\\2') AS dest_name FROM documents) f
JOIN ({_SQL_PICKS}) p USING (folder, dest_name) WHERE f.name <> p.source_name
""",
)
def _omitted(t: Tables) -> DataFrame:
    files = variant_files(t)
    return ingest.omitted_variants(files, ingest.canonical_pick(files))


_SQL_EXISTING = f"SELECT folder, name, arg_min(size, ord) AS size FROM (SELECT source AS folder, {_SQL_VARIANT} AS name, n_chars * 20 AS size, doc_id AS ord FROM documents JOIN labels USING (doc_id)) GROUP BY 1, 2"


@query(
    "skip_existing",
    f"""
SELECT i.folder, i.name, i.ord, CASE WHEN e.name IS NULL THEN 'upload' WHEN i.name LIKE '%.pdf' AND e.size > 0 AND e.size < 98304 THEN 'replace' ELSE 'skip' END AS action
FROM (SELECT source AS folder, {_SQL_VARIANT} AS name, doc_id AS ord FROM documents) i LEFT JOIN ({_SQL_EXISTING}) e ON i.folder = e.folder AND i.name = e.name
""",
)
def _skip(t: Tables) -> DataFrame:
    files = variant_files(t)
    labelled = t.documents.join(t.labels, "doc_id", "left_semi").select(F.col("doc_id").alias("ord"), (F.col("n_chars") * 20).cast("string").alias("size"))
    existing = files.drop("size").join(labelled, "ord")
    return ingest.skip_existing(files.select("folder", "name", "ord"), existing)


@query(
    "download_outcomes",
    """
SELECT o_custkey AS tender_id, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus = 'F') AS n_ok, count(*) AS n_planned
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
""",
)
def _outcomes(t: Tables) -> DataFrame:
    planned = t.orders.select(F.col("o_custkey").alias("tender_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("url"))
    results = t.lineitem.select(
        F.col("l_orderkey").alias("item_id"), (F.col("l_returnflag") != "R").alias("ok"),
        F.when(F.col("l_linestatus") == "F", "p").otherwise("").alias("path"), F.lit(None).cast("string").alias("error"),
    )
    return ingest.outcome_counts(ingest.download_outcomes(planned, results, ["item_id"]))


@query(
    "unique_names",
    """
SELECT folder, ord, name, CASE WHEN n = 1 THEN name ELSE regexp_replace(name, '\\.txt$', '') || ' (' || n || ')' || CASE WHEN name LIKE '%.txt' THEN '.txt' ELSE '' END END AS dest_name
FROM (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY ord) AS n FROM (
  SELECT source AS folder, doc_id AS ord, lang || CASE WHEN lang = 'es' THEN '' ELSE '.txt' END AS name FROM documents))
""",
)
def _unique(t: Tables) -> DataFrame:
    name = F.concat("lang", F.when(F.col("lang") == "es", "").otherwise(".txt"))
    return ingest.unique_names(t.documents.select(F.col("source").alias("folder"), F.col("doc_id").alias("ord"), name.alias("name")))


_SQL_NUMBERED = "lang || CASE WHEN doc_id % 3 = 0 THEN ' (' || (doc_id % 7 + 2) || ')' || CASE WHEN doc_id % 9 = 0 THEN ' (2)' ELSE '' END ELSE '' END"


@query(
    "unique_names_numbered",
    f"""
WITH RECURSIVE f AS (SELECT source AS folder, doc_id AS ord, {_SQL_NUMBERED} AS base, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
s AS (SELECT folder, 0::BIGINT AS n, NULL::BIGINT AS ord, NULL::VARCHAR AS base, NULL::VARCHAR AS dest, []::VARCHAR[] AS used FROM (SELECT DISTINCT folder FROM f)
  UNION ALL
  SELECT folder, n, ord, base, dest, list_append(used, dest) FROM (
    SELECT s.folder, f.n, f.ord, f.base, s.used, CASE WHEN NOT list_contains(s.used, f.base) THEN f.base
        ELSE f.base || ' (' || list_filter(range(2, len(s.used) + 3), lambda i: NOT list_contains(s.used, f.base || ' (' || i || ')'))[1] || ')' END AS dest
    FROM s JOIN f ON f.folder = s.folder AND f.n = s.n + 1) AS j)
SELECT folder, ord, base || '.txt' AS name, dest || '.txt' AS dest_name FROM s WHERE n > 0
""",
)
def _unique_numbered(t: Tables) -> DataFrame:
    """Names that come in numbered forms already, some of them twice."""
    n = F.col("doc_id")
    again = F.when(n % 9 == 0, " (2)").otherwise("")
    name = F.concat("lang", F.when(n % 3 == 0, F.concat(F.lit(" ("), (n % 7 + 2).cast("string"), F.lit(")"), again)).otherwise(""), F.lit(".txt"))
    return ingest.unique_names(t.documents.select(F.col("source").alias("folder"), n.alias("ord"), name.alias("name")))


@query(
    "latest_version",
    """
SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1
""",
)
def _latest(t: Tables) -> DataFrame:
    orders = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    newest = picks.latest_version(orders, ["o_custkey"], "o_orderdate", "o_orderkey")
    return newest.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey", "o_orderstatus")


_SQL_SERIAL = "SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS serial FROM orders"


def serial_orders(t: Tables) -> DataFrame:
    buckets = [F.to_date("o_orderdate"), ordered_bucket(F.col("o_orderkey"), t.orders)]
    return picks.serial_numbers(t.orders, ["o_orderdate", "o_orderkey"], buckets)


@query("serial_numbers", f"SELECT o_orderkey, serial FROM ({_SQL_SERIAL})")
def _serial(t: Tables) -> DataFrame:
    return serial_orders(t).select("o_orderkey", "serial")


@query(
    "outgoing_ref",
    f"""
SELECT o_orderkey, 'Исх. № ' || CASE o_orderstatus WHEN 'F' THEN 'AA' WHEN 'O' THEN 'BB' ELSE 'ЛН' END || '-' || strftime(o_orderdate, '%Y') || '/'
  || CASE WHEN serial < 10000 THEN lpad(CAST(serial AS VARCHAR), 4, '0') ELSE CAST(serial AS VARCHAR) END || ' от ' || strftime(o_orderdate, '%d.%m.%Y') AS ref,
  serial || ', ' || strftime(o_orderdate, '%d.%m.%Y') AS line FROM ({_SQL_SERIAL})
""",
)
def _ref(t: Tables) -> DataFrame:
    prefix = F.when(F.col("o_orderstatus") == "F", "AA").when(F.col("o_orderstatus") == "O", "BB")
    serial, date = F.col("serial"), F.col("o_orderdate")
    return serial_orders(t).select("o_orderkey", picks.outgoing_ref(serial, date, prefix).alias("ref"), picks.serial_line(serial, date).alias("line"))


_SQL_TEMPLATE = "SELECT {keys}, arg_min(p_partkey, (NOT regexp_matches(p_name, '{pattern}'), p_name, p_partkey)) AS template_id FROM part {where} GROUP BY ALL"


@query("template_pick", _SQL_TEMPLATE.format(keys="p_brand AS org, p_type", pattern="ring|gear", where=""))
def _template(t: Tables) -> DataFrame:
    docs = t.part.select(F.col("p_brand").alias("org"), "p_type", F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return picks.template_pick(docs, ["org", "p_type"], "ring|gear")


def _sql_side(where: str) -> str:
    return "(" + _SQL_TEMPLATE.format(keys="p_brand AS org", pattern="ring", where=f"WHERE {where}") + ")"


_SIDES = ("p_size = 1 AND p_type = 'ECONOMY'", "p_size = 2 AND p_type = 'PROMO'", "p_size = 3", "p_size > 3")


@query(
    "template_waterfall",
    "SELECT o.org, coalesce(a.template_id, b.template_id, c.template_id, d.template_id) AS template_id FROM (SELECT DISTINCT p_brand AS org FROM part) o "
    + " ".join(f"LEFT JOIN {_sql_side(w)} {n} ON {n}.org = o.org" for n, w in zip("abcd", _SIDES)),
)
def _waterfall(t: Tables) -> DataFrame:
    docs = t.part.select(
        F.col("p_brand").alias("org"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size", "p_type"
    )
    sides = [picks.template_pick(docs.where(w), ["org"], "ring") for w in _SIDES]
    return picks.template_waterfall(docs.select("org").distinct(), *sides)
