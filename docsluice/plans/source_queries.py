"""Queries of readers, writers and provider slots over ``documents``, and of the small rules they rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.functions import html as hx
from docsluice.functions import messages as mx
from docsluice.functions import text as tx
from docsluice.operators import cards, corpus, extraction, ingest, picks, requirements
from docsluice.plans.card_queries import _SQL_ORDERS, order_cards
from docsluice.plans.corpus_queries import SQL_PATH, document_texts, sql_chunks
from docsluice.plans.message_queries import VIEW_URL
from docsluice.plans.registry import Tables, query, sql_collapse, sql_trim
from docsluice.session import ensure_checkpoint_dir, shared_folder, spread
from docsluice.sources import providers, readers, sinks


@query(
    "read_chunk_index",
    f"""
SELECT path || '#' || chunk_index AS chunk_id, text, path AS source_path, chunk_index, chunk_count FROM ({sql_chunks('text', 3500, 420)})
""",
)
def _round_trip(t: Tables) -> DataFrame:
    """The index of the documents, written to the shared folder and read back."""
    ensure_checkpoint_dir(t.spark)
    folder = t.spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/index-{uuid.uuid4().hex}"
    rows = corpus.chunk_table(document_texts(t)).withColumn("embedding", F.array().cast("array<double>"))
    sinks.write_chunk_index(rows, path)
    index = readers.read_chunk_index(t.spark, path)
    return index.select(
        "chunk_id", "text", "metadata.source_path", F.col("metadata.chunk_index").cast("bigint").alias("chunk_index"),
        F.col("metadata.chunk_count").cast("bigint").alias("chunk_count"),
    )


@query(
    "attachment_ok",
    """
SELECT doc_id, kind, kind = 'pdf' OR kind = 'zip' AS ok, CASE WHEN kind = 'html' THEN 'html' WHEN kind = 'unknown' THEN 'not_pdf' END AS reason FROM (
  SELECT doc_id, CASE lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'zip' WHEN 'de' THEN 'html' ELSE 'unknown' END AS kind FROM documents)
""",
)
def _attachment(t: Tables) -> DataFrame:
    checked = _files(t).select(
        "doc_id", ingest.attachment_kind(F.col("content")).alias("kind"),
        ingest.attachment_ok(F.col("content"), F.col("name"), F.lit("")).alias("r"),
    )
    return checked.select("doc_id", "kind", "r.ok", "r.reason")


def _files(t: Tables) -> DataFrame:
    """Texts behind the signature of a file kind, named as PDF or as DOCX."""
    lang = F.col("lang")
    mark = F.when(lang == "en", "%PDF-1.4 0123456789 ").when(lang == "fr", "PK\x03\x04 0123456789abcdef ").when(
        lang == "de", " <!DOCTYPE html><html> "
    ).otherwise("0123456789abcdef ")
    content = F.encode(F.concat(mark, "text"), "UTF-8")
    name = F.when(lang == "fr", "a.docx").otherwise("a.PDF")
    return t.spread("documents", "doc_id", "lang", "text").select("doc_id", content.alias("content"), name.alias("name"))


@query(
    "read_attachments",
    """
SELECT doc_id, kind, kind = 'pdf' OR kind = 'zip' AS ok, CASE WHEN kind = 'html' THEN 'html' WHEN kind = 'unknown' THEN 'not_pdf' END AS reason, size, least(size, 500) AS bytes_read FROM (
  SELECT doc_id, CASE lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'zip' WHEN 'de' THEN 'html' ELSE 'unknown' END AS kind,
         strlen(text) + CASE lang WHEN 'en' THEN 20 WHEN 'fr' THEN 22 WHEN 'de' THEN 23 ELSE 17 END AS size FROM documents)
""",
)
def _read_attachments(t: Tables) -> DataFrame:
    """The same files written below the shared folder, and judged by their sizes and first bytes."""
    root = f"{shared_folder(t.spark)}/attachments-{uuid.uuid4().hex}"
    sinks.write_attachments(_files(t).withColumn("name", F.concat(F.col("doc_id").cast("string"), F.lit("-"), "name")), root)
    read = readers.read_attachments(t.spark, root)
    checked = read.select(
        F.substring_index("name", "-", 1).cast("bigint").alias("doc_id"), ingest.attachment_kind(F.col("head")).alias("kind"),
        ingest.attachment_ok(F.col("head"), F.col("name"), F.lit(""), F.col("size")).alias("r"), "size", "bytes_read",
    )
    return checked.select("doc_id", "kind", "r.ok", "r.reason", "size", "bytes_read")


@query(
    "extract_text",
    f"""
SELECT doc_id, CASE WHEN lang = 'en' THEN 'native_utf8' ELSE 'binary_office' END AS kind, CASE WHEN lang = 'en' THEN 'utf8' ELSE 'reader' END AS extractor,
  t AS text, false AS truncated
FROM (SELECT doc_id, lang, CASE WHEN lang = 'en' THEN {sql_trim('text')} ELSE text END AS t FROM documents)
""",
)
def _extract(t: Tables) -> DataFrame:
    """English documents are text files; the others are read by a provider."""
    rows = spread(t.documents).select(
        "doc_id", F.when(F.col("lang") == "en", "a.txt").otherwise("a.pdf").alias("name"), F.lit("").alias("mime"), F.encode("text", "UTF-8").alias("content")
    )
    out = extraction.extract_texts(rows, lambda content, name, mime: (bytes(content).decode(), None, "reader"))
    return out.select("doc_id", "kind", "extractor", "text", "truncated")


@query("complete", "SELECT doc_id, length(text) || ' characters, ' || (length(text) - length(replace(text, ' ', ''))) || ' blanks' AS reply FROM documents")
def _complete(t: Tables) -> DataFrame:
    """A provider that answers each prompt with what it counts in it."""
    rows = t.documents.select("doc_id", F.col("text").alias("prompt"))
    return providers.complete(rows, lambda prompts: [f"{len(p)} characters, {p.count(' ')} blanks" for p in prompts]).select("doc_id", "reply")


@query(
    "tender_year",
    """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y') WHEN o_orderstatus = 'O' THEN '2031' END AS year FROM orders
""",
)
def _year(t: Tables) -> DataFrame:
    given = F.when(F.col("o_orderstatus") == "F", " ").when(F.col("o_orderstatus") == "O", "2031").otherwise("31")
    return t.orders.select("o_orderkey", picks.tender_year(given, F.col("o_orderdate")).alias("year"))


@query(
    "procedure_ref_form",
    f"SELECT page_id, page_id || '-1' AS reference, 'Запрос ценовых предложений' AS form FROM ({_SQL_ORDERS})",
)
def _procedure(t: Tables) -> DataFrame:
    found = order_cards(t).select("page_id", cards.procedure_ref_form(hx.strip_html(F.col("html"))).alias("p"))
    return found.select("page_id", "p.reference", "p.form")


@query("dl_pairs", f"SELECT page_id, 'Срок поставки' AS key, priority AS value FROM ({_SQL_ORDERS})")
def _pairs(t: Tables) -> DataFrame:
    rows = order_cards(t).select("page_id", F.explode(cards.dl_pairs(F.col("html"))).alias("p"))
    return rows.select("page_id", "p.key", "p.value")


@query(
    "labelled_hints",
    f"""
SELECT doc_id, 'Заказчик' AS key, CASE WHEN length(line) = 3 THEN line ELSE {sql_collapse("regexp_extract(line, '^([^\n\r.]{4,240})', 1)")} END AS value FROM (
  SELECT doc_id, ltrim(regexp_replace({sql_collapse('text')}, '[.]', '', 'g')) AS line FROM documents) WHERE length(line) >= 3
""",
)
def _hints(t: Tables) -> DataFrame:
    """Every text, without its full stops, behind the label of the customer."""
    line = F.concat(F.lit("Заказчик: "), F.replace(tx.collapse_ws(F.col("text")), F.lit("."), F.lit("")))
    fields = cards.labelled_fields(F.lit(""), line)
    rows = t.spread("documents", "doc_id", "text").select("doc_id", F.explode(fields).alias("f"))
    return rows.select("doc_id", "f.key", "f.value")


@query(
    "has_context",
    """
SELECT conv_id, turn, turn > 4 OR length(text) < 500 OR regexp_matches(text, '(^|[^\\pL\\pN_])\\d{6,10}($|[^\\pL\\pN_])') AS context FROM conversations
""",
)
def _context(t: Tables) -> DataFrame:
    """Short messages hold a card address or a number; later turns reply to the bot."""
    n = F.length("text")
    body = F.when(n < 250, F.concat("text", F.lit(f" {VIEW_URL}5"))).when(n < 500, F.concat("text", F.lit(" № 1234567"))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", mx.has_context(body, F.col("turn") > 4, VIEW_URL).alias("context"))


@query(
    "read_parser_results",
    "SELECT doc_id || '.json' AS doc, CASE WHEN lang = 'de' THEN 'Ожидался объект JSON' END AS message FROM documents",
)
def _parser_results(t: Tables) -> DataFrame:
    """Files below the shared folder, a document in each; those that are no JSON become an issue and do not stop the batch."""
    root = f"{shared_folder(t.spark)}/results-{uuid.uuid4().hex}"
    json = F.when(F.col("lang") == "de", F.col("text")).otherwise('{"tender_id":"t","requirements":[],"deadlines":[],"meta":{"warnings":[]}}')
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json"))
    sinks.write_files(t.documents.select(path.alias("path"), F.encode(json, "UTF-8").alias("content")), root)
    parsed = requirements.parse_documents(readers.read_json_documents(t.spark, root))
    return requirements.with_issues(parsed, requirements.result_issues).select(F.col("doc_id").alias("doc"), "message")
