"""Queries of corpus assembly and grounding over ``documents`` and ``labels``: a source is a tender."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions import text as tx
from docsluice.operators import assembly, grounding
from docsluice.plans.registry import SQL_WS, Tables, query, sql_collapse, sql_trim
from docsluice.session import shared_folder
from docsluice.sources import readers, sinks


def _name() -> Column:
    return F.concat("lang", F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))


_SQL_NAME = "lang || '-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt'"


def source_files(t: Tables) -> DataFrame:
    """(tender_id, file_id, name, text) with a source as the tender."""
    return t.documents.select(F.col("source").alias("tender_id"), F.col("doc_id").alias("file_id"), _name().alias("name"), "text")


def manifest_items(t: Tables) -> DataFrame:
    """Every labelled document is in the manifest; bad ones failed, and those without a text file have no path."""
    rows = t.documents.join(t.labels, "doc_id")
    path = F.when(F.col("lang") == "es", "").otherwise(F.concat(F.lit("inputs/"), _name()))
    return rows.select(
        F.col("source").alias("tender_id"),
        F.col("doc_id").alias("ord"),
        _name().alias("name"),
        F.when((F.col("quality") == 0) & (F.col("toxic") == 0), "error").otherwise("ok").alias("status"),
        path.alias("path"),
    )


def manifest_files(t: Tables) -> DataFrame:
    """The files of the manifest; short German ones were never uploaded."""
    there = t.documents.where(~((F.col("lang") == "de") & (F.col("n_chars") < 1500)))
    return there.select(F.col("source").alias("tender_id"), _name().alias("path"), "text")


_SQL_ITEMS = f"""
SELECT source AS tender_id, doc_id AS ord, {_SQL_NAME} AS name, CASE WHEN quality = 0 AND toxic = 0 THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN lang = 'es' THEN '' ELSE 'inputs/' || {_SQL_NAME} END AS path,
       NOT (lang = 'de' AND n_chars < 1500) AS present, {sql_trim('text')} AS text
FROM documents JOIN labels USING (doc_id)"""


@query(
    "items_to_text",
    f"""
SELECT tender_id, ord, CASE WHEN status = 'ok' AND path <> '' AND present THEN length(nullif(text, '')) END AS n_chars,
       CASE WHEN status = 'error' OR path = '' OR NOT present OR text = '' THEN name END AS not_parsed,
       CASE WHEN status = 'error' THEN name || ': ошибка парсинга'
            WHEN path <> '' AND NOT present THEN name || ': не найден файл для ' || path END AS warning
FROM ({_SQL_ITEMS})
""",
)
def _items_to_text(t: Tables) -> DataFrame:
    rows = assembly.items_to_text(manifest_items(t), manifest_files(t))
    return rows.select("tender_id", "ord", F.length("text").cast("bigint").alias("n_chars"), "not_parsed", "warning")


_SQL_CORPUS = f"""
SELECT tender_id, string_agg('### Документ: ' || name || chr(10) || '_Путь: ' || path || '_' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY ord) AS corpus, count(*) AS n_files
FROM ({_SQL_ITEMS}) WHERE status = 'ok' AND path <> '' AND present AND text <> '' GROUP BY 1"""


def sql_parts(whole: str, chars: int, column: str = "corpus", more: str = "") -> str:
    """Numbered parts of the whole texts of a query."""
    return f"""
SELECT tender_id, i AS part, i * {chars} AS start, substring({column}, CAST(i * {chars} + 1 AS BIGINT), {chars}) AS text{more}
FROM (SELECT *, unnest(range(0, (length({column}) - 1) // {chars} + 1)) AS i FROM ({whole}) WHERE length({column}) > 0)"""


@query("assemble_corpus", sql_parts(_SQL_CORPUS, 20_000))
def _assemble(t: Tables) -> DataFrame:
    return assembly.assemble_corpus(manifest_items(t), manifest_files(t))


@query("corpus_sizes", f"SELECT tender_id, n_files, CAST(length({sql_collapse('corpus')}) AS BIGINT) AS input_chars FROM ({_SQL_CORPUS})")
def _sizes(t: Tables) -> DataFrame:
    return assembly.corpus_sizes(manifest_items(t), manifest_files(t))


def _sql_files(head: str, tail: str, text: str, where: str = "") -> str:
    """Whole texts of all files by name, below their headers."""
    return f"""
SELECT tender_id, regexp_replace(string_agg({head} || name || {tail} || text, chr(10) || chr(10) ORDER BY name, file_id), '{SQL_WS}+$', '') AS corpus
FROM (SELECT source AS tender_id, doc_id AS file_id, {_SQL_NAME} AS name, {text} AS text FROM documents {where}) GROUP BY 1"""


_SQL_NATIVE = _sql_files("'=== '", "' ===' || chr(10)", "text")


@query("assemble_corpus_budget", sql_parts(_SQL_NATIVE, 95_000))
def _budget(t: Tables) -> DataFrame:
    """All files in parts of the size of a budget: the first part is what the budget reaches, the others what it leaves."""
    return assembly.assemble_files(source_files(t), part_chars=95_000)


@query(
    "corpus_left_out",
    f"""
SELECT tender_id, file_id, name, CAST(kept AS BIGINT) AS kept_chars, CAST(size - kept AS BIGINT) AS left_chars FROM (
  SELECT *, CASE WHEN room > 0 THEN least(room, size) ELSE 0 END AS kept FROM (
    SELECT *, 95000 - coalesce(sum(head + size) OVER (PARTITION BY tender_id ORDER BY name, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - head AS room
    FROM (SELECT source AS tender_id, doc_id AS file_id, {_SQL_NAME} AS name, length({_SQL_NAME}) + 11 AS head, length(text) AS size FROM documents)))
WHERE size > kept
""",
)
def _left_out(t: Tables) -> DataFrame:
    return assembly.left_out(source_files(t), 95_000)


@query(
    "corpus_within_budget",
    f"""
SELECT tender_id, {sql_trim("string_agg(part, '' ORDER BY name, file_id)")} AS corpus, count(*) AS n_files FROM (
  SELECT tender_id, name, file_id, header || CASE WHEN length(text) > room THEN substring(text, 1, CAST(room AS BIGINT)) || chr(10) || '…[файл усечён]' ELSE text END AS part
  FROM (SELECT *, 95000 - coalesce(sum(length(header) + length(text)) OVER (PARTITION BY tender_id ORDER BY name, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          - length(header) AS room
        FROM (SELECT source AS tender_id, doc_id AS file_id, {_SQL_NAME} AS name, chr(10) || chr(10) || '=== ' || {_SQL_NAME} || ' ===' || chr(10) AS header, text FROM documents))
  WHERE room > 0) GROUP BY 1
""",
)
def _within(t: Tables) -> DataFrame:
    """What a budget reaches, as one text; ``corpus_left_out`` lists what it does not."""
    return assembly.assemble_by_budget(source_files(t), 95_000)


@query("read_text_folder", sql_parts(_sql_files("'### Реквизиты · файл: '", "chr(10)", sql_trim("text"), f"WHERE {sql_trim('text')} <> ''"), 20_000))
def _folder(t: Tables) -> DataFrame:
    """The documents as files, a folder for each source, read back and put together."""
    root = f"{shared_folder(t.spark)}/folders-{uuid.uuid4().hex}"
    path = F.concat("source", F.lit("/"), _name())
    rows = t.spread("documents", "doc_id", "source", "lang", "text")
    sinks.write_files(rows.select(path.alias("path"), F.encode("text", "UTF-8").alias("content")), root)
    return assembly.folder_texts(readers.read_text_folder(t.spark, root)).withColumnRenamed("folder", "tender_id")


@query(
    "budget_running_sum",
    """
SELECT tender_id, file_id, CAST(room AS BIGINT) AS room FROM (
  SELECT source AS tender_id, doc_id AS file_id, 12000 - coalesce(sum(n_chars + 10) OVER (
    PARTITION BY source ORDER BY lang, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 10 AS room FROM documents)
WHERE room > 0
""",
)
def _running(t: Tables) -> DataFrame:
    sizes = t.documents.select(
        F.col("source").alias("tender_id"), F.col("doc_id").alias("file_id"), F.col("lang").alias("name"),
        F.lit(10).alias("head"), F.col("n_chars").alias("size"),
    )
    return assembly.within_budget(sizes, 12_000, 0, "tender_id", 64).select("tender_id", "file_id", "room")


@query(
    "snippet_corpus",
    sql_parts(
        f"""
SELECT tender_id, string_agg('### Файл: ' || name || chr(10) || s, chr(10) || chr(10) ORDER BY doc_id) AS corpus FROM (
  SELECT source AS tender_id, doc_id, {_SQL_NAME} AS name, {sql_trim('text')} AS s FROM documents) WHERE length(s) > 40 GROUP BY 1""",
        20_000,
    ),
)
def _snippets(t: Tables) -> DataFrame:
    files = t.documents.select(F.col("source").alias("tender_id"), F.col("doc_id").alias("ord"), _name().alias("name"), "text")
    return assembly.snippet_corpus(files)


_SQL_BY_LANGUAGE = "SELECT * REPLACE (source || '/' || lang AS source) FROM documents"


@query(
    "corpus_source",
    f"""
WITH d AS ({_SQL_BY_LANGUAGE}), e AS ({sql_parts(_SQL_CORPUS.replace("FROM documents", "FROM d"), 20_000)}),
     n AS ({sql_parts(_SQL_NATIVE.replace("FROM documents", "FROM d"), 20_000)})
SELECT *, 'extracted' AS source FROM e UNION ALL SELECT *, 'inputs_native' FROM n WHERE tender_id NOT IN (SELECT tender_id FROM e)
""",
)
def _source(t: Tables) -> DataFrame:
    """A tender is a source and a language here: the Spanish ones have no parsed texts."""
    by_language = lambda rows: rows.withColumn("tender_id", F.concat("tender_id", F.lit("/"), F.substring("name", 1, 2)))
    items = by_language(manifest_items(t))
    files = manifest_files(t).withColumn("tender_id", F.concat("tender_id", F.lit("/"), F.substring("path", 1, 2)))
    return assembly.corpus_source(assembly.assemble_corpus(items, files), assembly.assemble_files(by_language(source_files(t))))


@query(
    "enough_text",
    f"""
SELECT doc_id, n AS collapsed_chars, n >= 120 AS analysis_ok, n >= 400 AS card_ok
FROM (SELECT doc_id, CAST(length({sql_collapse('text')}) AS BIGINT) AS n FROM documents)
""",
)
def _enough(t: Tables) -> DataFrame:
    return assembly.enough_text(t.documents, "text").select("doc_id", "collapsed_chars", "analysis_ok", "card_ok")


@query(
    "normalize_evidence",
    f"""
SELECT doc_id, {sql_collapse("translate(text, '«»„“”’′', chr(34) || chr(34) || chr(34) || chr(34) || chr(34) || chr(39) || chr(39))")} AS norm
FROM documents
""",
)
def _normalize(t: Tables) -> DataFrame:
    return t.spread("documents", "doc_id", "text").select("doc_id", tx.normalize_evidence(F.col("text")).alias("norm"))


# Claims: every line of a document is claimed for that document, and for the next one, where it is grounded only if the
# documents share it.  Half of the quotes arrive with other blanks, every long one with a changed end.
_SQL_CLAIMS = """
SELECT d.doc_id + o.shift AS tender_id, d.doc_id || ':' || l.i || ':' || o.shift AS claim_id,
       CASE WHEN o.shift = 0 THEN 'self' ELSE 'manager' END AS list, 'claim ' || l.i AS name,
       CASE WHEN lang = 'de' THEN '' ELSE lang END AS basis,
       CASE WHEN lang = 'fr' THEN upper(l.line) ELSE l.line END AS criteria,
       CASE WHEN length(l.line) > 200 THEN l.line || ' changed' ELSE replace(l.line, ' ', chr(160)) END AS evidence
FROM documents d, (SELECT unnest([0, 1]) AS shift) o,
     LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, unnest(range(0, len(string_split(d.text, chr(10))))) AS i) l"""


def line_claims(t: Tables) -> DataFrame:
    rows = t.spread("documents", "doc_id", "lang", "text")
    lines = rows.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    rows = lines.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(
        (F.col("doc_id") + F.col("shift")).alias("tender_id"),
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("i").cast("string"), F.col("shift").cast("string")).alias("claim_id"),
        F.when(F.col("shift") == 0, "self").otherwise("manager").alias("list"),
        F.concat(F.lit("claim "), F.col("i").cast("string")).alias("name"),
        F.when(F.col("lang") == "de", "").otherwise(F.col("lang")).alias("basis"),
        F.when(F.col("lang") == "fr", F.upper("line")).otherwise(F.col("line")).alias("criteria"),
        F.when(F.length("line") > 200, F.concat("line", F.lit(" changed")))
        .otherwise(F.replace("line", F.lit(" "), F.lit("\u00a0")))
        .alias("evidence"),
    )


def document_corpora(t: Tables) -> DataFrame:
    return t.spread("documents", "doc_id", "text").select(F.col("doc_id").alias("tender_id"), F.col("text").alias("corpus"))


def _sql_norm(expr: str) -> str:
    return sql_collapse(f"translate({expr}, '«»„“”’′', chr(34) || chr(34) || chr(34) || chr(34) || chr(34) || chr(39) || chr(39))")


def _sql_quoted(quote: str, corpus: str) -> str:
    return f"(length({quote}) >= 14 AND contains({corpus}, {quote}))"


def _sql_place(quote: str, corpus: str) -> str:
    """First place from 0; NULL for a quote that is too short or stands nowhere."""
    return f"CASE WHEN length({quote}) >= 14 THEN nullif(strpos({corpus}, {quote}), 0) - 1 END"


@query(
    "ground_claims",
    f"""
WITH c AS ({_SQL_CLAIMS}), n AS (SELECT c.*, {_sql_norm('evidence')} AS e, {_sql_norm('criteria')} AS cr,
       coalesce(d.norm, '') AS corpus FROM c LEFT JOIN (SELECT doc_id, {_sql_norm('text')} AS norm FROM documents) d ON d.doc_id = c.tender_id)
SELECT tender_id, claim_id, list, name, CASE WHEN basis = '' THEN '—' ELSE basis END AS basis, {_sql_quoted('e', 'corpus')} AS grounded,
       length(e) >= 14 AND contains(corpus, substring(e, 1, 96)) AS head_grounded,
       CASE WHEN list = 'manager' THEN CASE WHEN cr = '' OR (length({sql_collapse('criteria')}) >= 14 AND NOT {_sql_quoted('cr', 'corpus')}) THEN '—'
            ELSE {sql_trim('criteria')} END END AS kept_criteria,
       {_sql_place('e', 'corpus')} AS first_at, CASE WHEN length(e) >= 14 THEN {_sql_place('substring(e, 1, 96)', 'corpus')} END AS head_at,
       CASE WHEN list = 'manager' THEN {_sql_place('cr', 'corpus')} END AS criteria_at
FROM n
""",
)
def _ground_claims(t: Tables) -> DataFrame:
    claims = grounding.normalize_claims(line_claims(t))
    return grounding.ground_claims(claims, document_corpora(t)).drop("criteria", "evidence")


# Fields: a document's lines serve as values and quotes of the same document and, shifted, of the next one.
_SQL_FIELDS = """
SELECT doc_id + CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS tender_id, lines[1] AS title, lines[1] AS title_evidence,
       lines[2] AS budget, upper(lines[2]) AS budget_evidence, lang AS method, substring(lines[1], 1, 20) AS method_evidence,
       source AS deadline, lines[3] || 'x' AS deadline_evidence, 'overview ' || lang AS overview,
       [upper(lines[1]), lines[-1]] AS overview_quotes
FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents)"""


def document_fields(t: Tables) -> DataFrame:
    lines = F.split("text", "\n")
    get = lambda i: F.try_element_at(lines, F.lit(i))
    return t.spread("documents", "doc_id", "lang", "source", "text").select(
        (F.col("doc_id") + F.when(F.col("lang") == "fr", 1).otherwise(0)).alias("tender_id"),
        get(1).alias("title"),
        get(1).alias("title_evidence"),
        get(2).alias("budget"),
        F.upper(get(2)).alias("budget_evidence"),
        F.col("lang").alias("method"),
        F.substring(get(1), 1, 20).alias("method_evidence"),
        F.col("source").alias("deadline"),
        F.concat(get(3), F.lit("x")).alias("deadline_evidence"),
        F.concat(F.lit("overview "), "lang").alias("overview"),
        F.array(F.upper(get(1)), get(-1)).alias("overview_quotes"),
    )


def _sql_grounded_fields() -> str:
    def kept(name: str) -> str:
        ok = _sql_quoted(_sql_norm(f"{name}_evidence"), "corpus")
        return f"CASE WHEN {ok} THEN nullif({sql_trim(name)}, '') END AS {name}"

    fields = ", ".join(kept(name) for name in grounding.FIELDS)
    quotes = " OR ".join(
        f"coalesce({_sql_quoted(_sql_norm(f'overview_quotes[{i}]'), 'corpus')}, false)" for i in (1, 2)
    )
    return f"""
SELECT tender_id, {fields}, CASE WHEN {quotes} THEN overview END AS overview
FROM (SELECT f.*, coalesce(d.norm, '') AS corpus FROM ({_SQL_FIELDS}) f
      LEFT JOIN (SELECT doc_id, {_sql_norm('text')} AS norm FROM documents) d ON d.doc_id = f.tender_id)"""


@query("ground_fields", _sql_grounded_fields())
def _ground_fields(t: Tables) -> DataFrame:
    return grounding.ground_fields(document_fields(t), document_corpora(t))


@query(
    "snapshot_fallback",
    f"""
SELECT tender_id, title, method, overview, coalesce(budget, h.budget_hint) AS budget, coalesce(deadline, h.deadline_hint) AS deadline
FROM ({_sql_grounded_fields()}) LEFT JOIN (
  SELECT doc_id, 'q' || quality AS budget_hint, CASE WHEN toxic = 1 THEN 'toxic' END AS deadline_hint FROM labels) h ON h.doc_id = tender_id
""",
)
def _fallback(t: Tables) -> DataFrame:
    hints = t.labels.select(
        F.col("doc_id").alias("tender_id"),
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("budget_hint"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("deadline_hint"),
    )
    return grounding.snapshot_fallback(grounding.ground_fields(document_fields(t), document_corpora(t)), hints)


@query(
    "truncate_marked",
    "SELECT doc_id, CASE WHEN length(text) > 1200 THEN substring(text, 1, 1200) || '…' ELSE text END AS short FROM documents",
)
def _truncate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.truncate_marked(F.col("text"), 1200, "…").alias("short"))
