"""Queries of prompts, replies and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.functions import text as tx
from docsluice.operators import assembly, inventory, policy, prompts
from docsluice.plans import policy_queries as pq
from docsluice.plans.assembly_queries import _SQL_NAME, _SQL_NATIVE, source_files, sql_parts
from docsluice.plans.registry import Tables, query, sql_collapse, sql_trim
from docsluice.plans.search_queries import _BLOCK, _sql_hits, hits_with_documents
from docsluice.session import spread


@query(
    "rag_prompt",
    f"""
SELECT query_id, chr(10) || string_agg({_BLOCK}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY hit_rank) || chr(10) || chr(10) || 'Вопрос пользователя: ' || 'vector ' || query_id AS prompt
FROM ({_sql_hits(6)}) JOIN documents ON doc_id = chunk_id GROUP BY query_id
""",
)
def _rag(t: Tables) -> DataFrame:
    found = hits_with_documents(t, 6).withColumnRenamed("source", "path")
    questions = t.embeddings.select(F.col("vec_id").alias("query_id"), F.concat(F.lit(" vector "), F.col("vec_id").cast("string")).alias("question"))
    out = prompts.rag_prompt(found, questions)
    return out.withColumn("prompt", F.expr("substring(prompt, 2)"))


@query(
    "archive_context",
    f"""
SELECT query_id, string_agg({sql_trim('text')}, chr(10) || '---' || chr(10) ORDER BY hit_rank) AS archive
FROM ({_sql_hits(6)}) JOIN documents ON doc_id = chunk_id WHERE {sql_trim('text')} <> '' GROUP BY query_id
""",
)
def _archive(t: Tables) -> DataFrame:
    return prompts.archive_context(hits_with_documents(t, 8))


@query(
    "analysis_prompt",
    f"""
SELECT CAST(doc_id AS VARCHAR) AS tender_id, 'tender_id: ' || doc_id || chr(10) || chr(10) || CASE WHEN lang = 'en' THEN '{prompts.CORPUS_HEADING}' ELSE '{prompts.SNIPPETS_HEADING}' END
  || chr(10) || text || chr(10) || chr(10) || '{prompts.ARCHIVE_HEADING}' || chr(10) || '{prompts.NO_CARD}' AS prompt FROM documents WHERE length({sql_collapse('text')}) >= 120
""",
)
def _analysis(t: Tables) -> DataFrame:
    corpora = t.documents.select(
        F.col("doc_id").cast("string").alias("tender_id"), F.col("text").alias("corpus"), (F.col("lang") == "en").alias("parsed")
    )
    return prompts.analysis_prompt(corpora)


@query(
    "card_prompt",
    f"""
SELECT CAST(doc_id AS VARCHAR) AS tender_id, 'tender_id / view: ' || doc_id || chr(10) || chr(10) || '{prompts.CORPUS_HEADING}' || chr(10) || CASE WHEN lang = 'de' THEN '{prompts.NO_TEXT}' ELSE text END
  || chr(10) || chr(10) || '{prompts.CARD_HEADING}' || chr(10) || coalesce(html, '{prompts.NO_CARD}') AS prompt FROM documents LEFT JOIN pages ON page_id = doc_id
""",
)
def _card(t: Tables) -> DataFrame:
    corpora = t.documents.select(F.col("doc_id").cast("string").alias("tender_id"), F.when(F.col("lang") == "de", "").otherwise(F.col("text")).alias("corpus"))
    cards = t.pages.select(F.col("page_id").cast("string").alias("tender_id"), F.col("html").alias("card_text"))
    return prompts.card_prompt(corpora, cards)


@query(
    "price_quote_merge",
    """
SELECT o_custkey AS tender_id, concat_ws(chr(10), CASE WHEN quote <> '' THEN '### Согласованная цена и условия' || chr(10) || quote || chr(10) || '---' END, nullif(prep, '')) AS preparation,
  quote <> '' AS has_quote, CASE WHEN quote = '' AND prep = '' THEN 'нет подготовленного входа и согласованной цены' END AS warning
FROM (SELECT c_custkey AS o_custkey, CASE WHEN c_acctbal < 3000 THEN '' ELSE c_mktsegment END AS prep, coalesce(quote, '') AS quote FROM customer LEFT JOIN (
  SELECT o_custkey, arg_max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END, (o_orderdate, o_orderkey)) AS quote FROM orders GROUP BY 1) q ON q.o_custkey = c_custkey)
""",
)
def _quote(t: Tables) -> DataFrame:
    preparations = t.customer.select(F.col("c_custkey").alias("tender_id"), F.when(F.col("c_acctbal") < 3000, "").otherwise(F.col("c_mktsegment")).alias("preparation"))
    quotes = t.orders.select(
        F.col("o_custkey").alias("tender_id"), F.struct("o_orderdate", "o_orderkey").alias("saved_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("").alias("quote"),
    )
    return prompts.price_quote_merge(preparations, quotes)


def _claims(t: Tables) -> DataFrame:
    """Suppliers of a nation as the claims of one tender."""
    return t.supplier.select(
        F.col("s_nationkey").alias("tender_id"), F.when(F.col("s_acctbal") > 0, "manager").otherwise("self").alias("list"), F.col("s_suppkey").alias("ord"),
        F.col("s_name").alias("name"), F.concat(F.lit("a|b\nc "), F.col("s_nationkey").cast("string")).alias("basis"),
        F.when(F.col("s_acctbal") > 5000, "—").otherwise("до срока").alias("criteria"),
    )


_SQL_MATRIX = """
SELECT tender_id, n, '| ' || n || ' | ' || s_name || ' | ' || role || ' | a\\|b c ' || tender_id || CASE WHEN role = 'Менеджер' AND s_acctbal <= 5000 THEN ' до срока' ELSE '' END || ' |' AS line
FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END, s_suppkey) AS n, s_nationkey AS tender_id,
        CASE WHEN s_acctbal > 0 THEN 'Менеджер' ELSE 'Автор' END AS role FROM supplier)"""


@query("matrix_numbering", _SQL_MATRIX)
def _numbering(t: Tables) -> DataFrame:
    return prompts.matrix_numbering(_claims(t), "Автор").withColumn("n", F.col("n").cast("bigint"))


_SQL_PREPARATION = f"""
SELECT n_nationkey AS tender_id, '---' || chr(10) || 'tender_id: ' || n_nationkey || chr(10) || '---' || chr(10) || '- **Наименование / предмет:** ' || n_name || chr(10) || '- **Сумма / бюджет в тексте:** —' || chr(10)
  || '- **Способ подачи:** —' || chr(10) || '- **Дедлайн приёма:** ' || n_regionkey || chr(10) || '## Политика цены в КП' || chr(10)
  || CASE WHEN n_regionkey = 0 THEN '{prompts.PRICE_ABSURD}' WHEN n_regionkey = 1 THEN '{prompts.PRICE_REDUCTION}' ELSE '{prompts.PRICE_NONE}' END || chr(10) || '## Матрица требований' || chr(10)
  || coalesce('| № | Требование / документ | Роль | Суть (по документам) |' || chr(10) || '|---|---|---|---|' || chr(10) || lines, '{prompts.EMPTY_MATRIX}') AS preparation
FROM nation LEFT JOIN (SELECT tender_id, string_agg(line, chr(10) ORDER BY n) AS lines FROM ({_SQL_MATRIX}) GROUP BY 1) m ON m.tender_id = n_nationkey"""


@query("preparation_prompt", sql_parts(_SQL_PREPARATION, 20_000, "preparation"))
def _preparation(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    fields = t.nation.select(
        F.col("n_nationkey").alias("tender_id"), F.col("n_name").alias("title"), none.alias("budget"), F.lit("").alias("method"),
        F.col("n_regionkey").cast("string").alias("deadline"), none.alias("overview"),
    )
    flags = t.nation.select(F.col("n_nationkey").alias("tender_id"), (F.col("n_regionkey") <= 1).alias("has_reduction"), (F.col("n_regionkey") == 0).alias("absurd"))
    return prompts.preparation_prompt(fields, prompts.matrix_numbering(_claims(t), "Автор"), flags)


@query(
    "commercial_prompt_pack",
    f"""
SELECT o_orderkey, 'Закупка: ' || o_orderkey AS label, CASE WHEN reduction AND NOT low THEN 'стартовое предложение допустимо' ELSE 'цену согласовать с менеджером' END AS mode_line,
  'процедура снижения=' || CASE WHEN reduction THEN 'да' ELSE 'нет' END || '; подозрительная опорная цена=' || CASE WHEN low THEN 'да' ELSE 'нет' END AS flags_line,
  concat_ws(chr(10), CASE WHEN reduction THEN 'reduction_found' ELSE 'reduction_missing' END, CASE WHEN reduction THEN coalesce('reference: ' || raw, 'reference_missing') END,
    CASE WHEN low THEN 'reference below 100' END) AS reasons
FROM (SELECT *, amount > 0 AND amount < 100 AS low, CASE WHEN amount > 0 THEN shown || ' BYN' END AS raw FROM ({pq._SQL}))
""",
)
def _pack(t: Tables) -> DataFrame:
    analysed = policy.price_analysis(pq.order_corpora(t).withColumn("estimate", F.lit(None).cast("string")))
    return prompts.commercial_pack(analysed, "o_orderkey").select("o_orderkey", "label", "mode_line", "flags_line", "reasons")


_SQL_FACTS = "SELECT tender_id, bool_or(text LIKE '%the%') AS has_quote, min(length(text)) < 20 AS absurd, min(doc_id) % 2 = 0 AS below, count(*) % 3 <> 0 AS reduction FROM (SELECT source AS tender_id, * FROM documents) GROUP BY 1"
_SQL_POLICY = f"""
SELECT tender_id, '## Политика цены' || chr(10) || CASE WHEN has_quote THEN '- use_agreed_price' || chr(10) || '- no_placeholders' || CASE WHEN reduction THEN chr(10) || '- opening_price' ELSE '' END
  ELSE CASE WHEN absurd OR below OR NOT reduction THEN '- agree_price: ' || concat_ws(', ', CASE WHEN absurd THEN 'absurd_price' END, CASE WHEN below THEN 'below_threshold' END, CASE WHEN NOT reduction THEN 'no_reduction' END)
         || chr(10) || '- no_own_total' ELSE '- opening_price' || chr(10) || '- no_further_reduction' || chr(10) || '- vat_as_in_documents' END || chr(10) || '- figures_with_source' || chr(10) || '- no_invented_terms' END AS policy
FROM ({_SQL_FACTS})"""


def _price_facts(t: Tables, key: str = "source") -> DataFrame:
    """Flags per source, or per source and language, as a price analysis gives them."""
    rows = t.documents.groupBy(F.col(key).alias("tender_id"))
    return rows.agg(
        F.bool_or(F.col("text").contains("the")).alias("has_quote"), (F.min(F.length("text")) < 20).alias("absurd"), (F.min("doc_id") % 2 == 0).alias("below_threshold"),
        (F.count("*") % 3 != 0).alias("has_reduction"),
    )


@query("price_policy", _SQL_POLICY.replace("source AS tender_id", "lang || n_chars % 7 AS tender_id").replace("'%the%'", "'%wh%'"))
def _policy(t: Tables) -> DataFrame:
    rows = t.documents.groupBy(F.concat("lang", (F.col("n_chars") % 7).cast("string")).alias("tender_id"))
    return prompts.price_policy(
        rows.agg(
            F.bool_or(F.col("text").contains("wh")).alias("has_quote"), (F.min(F.length("text")) < 20).alias("absurd"), (F.min("doc_id") % 2 == 0).alias("below_threshold"),
            (F.count("*") % 3 != 0).alias("has_reduction"),
        )
    )


@query(
    "proposal_prompt",
    sql_parts(
        f"""
SELECT tender_id, 'Тендер: **' || tender_id || '**' || chr(10) || 'org ' || tender_id || chr(10) || 'requisites' || chr(10) || policy || chr(10) || '**Предупреждения:** a | b' || chr(10)
  || '## Корпус (документация заказчика)' || chr(10) || corpus AS corpus FROM ({_SQL_NATIVE}) JOIN ({_SQL_POLICY}) USING (tender_id)""",
        20_000,
    ),
)
def _proposal(t: Tables) -> DataFrame:
    rows = prompts.price_policy(_price_facts(t)).select(
        "tender_id", F.lit("").alias("preparation"), F.concat(F.lit("org "), "tender_id").alias("organisation"), F.lit(" requisites ").alias("requisites"),
        "policy", F.array(F.lit("a"), F.lit("b")).alias("warnings"),
    )
    return prompts.proposal_prompt(rows, assembly.assemble_files(source_files(t)))


@query(
    "agent_bundle",
    """
SELECT r_regionkey AS tender_id, 'nations' AS list, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) AS nth, n_name AS name, NULL::DOUBLE AS balance FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT n_regionkey, 'suppliers', row_number() OVER (PARTITION BY n_regionkey ORDER BY s_name), s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey
""",
)
def _bundle(t: Tables) -> DataFrame:
    nations = t.nation.select(F.col("n_regionkey").alias("tender_id"), F.col("n_name").alias("name"))
    suppliers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("tender_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return inventory.agent_bundle({"nations": nations, "suppliers": suppliers}, {"nations": "name", "suppliers": "name"})


@query(
    "bundle_prompt",
    sql_parts(
        """
SELECT source AS tender_id, '[' || string_agg('{"id":' || doc_id || ',"lang":"' || lang || '","name":"' || %s || '"}', ',' ORDER BY %s, doc_id) || ']' || chr(10) || chr(10) || 'Вопрос пользователя: что в папке?' AS corpus
FROM documents GROUP BY 1"""
        % (_SQL_NAME, _SQL_NAME),
        20_000,
    ),
)
def _bundle_prompt(t: Tables) -> DataFrame:
    json = F.concat(F.lit('{"id":'), F.col("file_id").cast("string"), F.lit(',"lang":"'), F.substring_index("name", "-", 1), F.lit('","name":"'), "name", F.lit('"}'))
    bundle = source_files(t).select("tender_id", "file_id", "name", json.alias("json"))
    questions = t.documents.select(F.col("source").alias("tender_id")).distinct().withColumn("question", F.lit(" что в папке? "))
    return prompts.bundle_prompt(bundle, questions)


@query(
    "import_summary",
    """
SELECT page_id AS view_id, '**Импорт выполнен**' || chr(10) || chr(10) || '**Наименование:** ' || CASE WHEN length(url) % 2 = 0 THEN url ELSE 'Закупка ' || page_id END || chr(10) || '**Заказчик:** —' || chr(10)
  || '**Сумма / стоимость:** ' || page_id || chr(10) || '**Дата подачи / дедлайн:** —' || chr(10) || CASE WHEN url LIKE 'https:%' THEN 'Документация (ссылка с карточки): ' || url ELSE 'Карточка закупки: ' || url END
  || chr(10) || chr(10) || '**Номер:** ' || page_id AS summary FROM pages
""",
)
def _import(t: Tables) -> DataFrame:
    link = F.struct(F.lit("n").alias("name"), F.col("url").alias("href"))
    none = F.lit(None).cast("string")
    snapshots = t.pages.select(
        F.col("page_id").alias("view_id"), F.when(F.length("url") % 2 == 0, F.col("url")).otherwise("short").alias("title"), none.alias("customer"),
        F.col("page_id").cast("string").alias("budget_hint"), F.lit("").alias("deadline_hint"), none.alias("folder_link"),
        F.when(F.col("url").startswith("https:"), F.array(link)).alias("document_links"), "url",
    )
    return prompts.import_summary(snapshots)


# Replies: the events' JSON, wrapped and damaged by type.
def replies(t: Tables) -> DataFrame:
    kind, props = F.col("event_type"), F.col("props")
    inner = F.regexp_replace(props, r"^\{|\}$", "")
    reply = (
        F.when(kind == "click", F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(kind == "error", F.concat(F.lit("Ответ: {"), inner, F.lit(", } конец")))
        .when(kind == "purchase", F.concat(F.lit("{"), F.translate(inner, '"', "'"), F.lit("}")))
        .when(kind == "view", "не JSON")
        .otherwise(props)
    )
    return spread(t.events).select(F.col("event_id").alias("tender_id"), "event_type", reply.alias("reply"))


@query(
    "lenient_json",
    "SELECT event_id AS tender_id, CASE WHEN event_type <> 'view' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_type = 'view' AS rejected FROM events",
)
def _json(t: Tables) -> DataFrame:
    parsed = prompts.read_replies(replies(t))
    return parsed.select("tender_id", F.try_variant_get("doc", "$.k", "bigint").alias("k"), F.col("doc").isNull().alias("rejected"))


_SQL_REPLY_CLAIMS = f"""
SELECT doc_id AS tender_id, CASE WHEN i = 0 THEN 'self' ELSE 'manager' END AS list, CASE WHEN i = 0 THEN lang ELSE source END AS name,
  CASE WHEN i = 0 THEN '—' ELSE 'because' END AS basis, {sql_trim("regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')")} AS evidence
FROM documents, (SELECT unnest([0, 1]) AS i) WHERE i = 1 OR lang <> 'de'"""


@query("normalize_claims", _SQL_REPLY_CLAIMS)
def _normalize_claims(t: Tables) -> DataFrame:
    """Replies with one claim per list; German own claims have no name and drop out."""
    words = F.regexp_replace("text", "[^A-Za-z0-9]+", " ")
    name = F.when(F.col("lang") == "de", " ").otherwise(F.col("lang"))
    reply = F.concat(
        F.lit('{"own":[{"name":"'), name, F.lit('","basis":" ","evidence":"'), words, F.lit('"},7],"ask":[{"name":" '), "source",
        F.lit('","reason":"because","evidence":"'), words, F.lit('"},]}'),
    )
    parsed = prompts.read_replies(spread(t.documents).select(F.col("doc_id").alias("tender_id"), reply.alias("reply")))
    claims = prompts.reply_claims(parsed, {"own": "self", "ask": "manager"})
    return claims.select("tender_id", "list", "name", "basis", "evidence")


@query(
    "normalize_card",
    """
SELECT doc_id AS tender_id, source AS title, CASE WHEN lang = 'en' THEN '—' ELSE lang END AS price_info, '—' AS deadline, source || ',' || lang AS names FROM documents
""",
)
def _normalize_card(t: Tables) -> DataFrame:
    price = F.when(F.col("lang") == "en", F.lit("5")).otherwise(F.concat(F.lit('"'), "lang", F.lit(' "')))
    reply = F.concat(
        F.lit('{"tenderTitle":" '), "source", F.lit('","priceInfo":'), price, F.lit(',"requiredDocumentNames":["'), "source", F.lit('"," ",3,"'), "lang", F.lit('"]}')
    )
    parsed = prompts.read_replies(spread(t.documents).select(F.col("doc_id").alias("tender_id"), reply.alias("reply")))
    card = prompts.reply_card(parsed)
    return card.select("tender_id", "title", "price_info", "deadline", F.array_join("document_names", ",").alias("names"))


@query(
    "matrix_bullets",
    """
SELECT s_suppkey AS ord, '- **' || s_name || '** — a|b' || chr(10) || 'c ' || s_nationkey || CASE WHEN s_acctbal > 0 AND s_acctbal <= 5000 THEN ' _(до срока)_' ELSE '' END AS line FROM supplier
""",
)
def _bullets(t: Tables) -> DataFrame:
    columns = [F.col(c) for c in ("list", "name", "basis", "criteria")]
    return _claims(t).select("ord", prompts.matrix_bullet(*columns).alias("line"))


# Text functions over whole documents.
@query("collapse_ws", f"SELECT doc_id, {sql_collapse('text')} AS flat FROM documents")
def _collapse(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.collapse_ws(F.col("text")).alias("flat"))


_SQL_MD = "'---' || chr(10) || 'k: v' || chr(10) || '---' || chr(10) || '# ' || replace(replace(text, chr(10), chr(10) || '- '), '. ', '. **b** *i* `c` ')"


def _markdown():
    return F.concat(
        F.lit("---\nk: v\n---\n# "), F.replace(F.replace("text", F.lit("\n"), F.lit("\n- ")), F.lit(". "), F.lit(". **b** *i* `c` "))
    )


@query(
    "markdown_to_plain",
    f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '^---(?:.|\\n)*?\\n---\\s*', ''),
  '(?m)^#{{1,6}}\\s+', '', 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\*([^*\\n]+)\\*', '\\1', 'g'), '`([^`]+)`', '\\1', 'g'), '(?m)^\\s*[-*+]\\s+', '• ', 'g'),
  '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\s+$', '') AS plain FROM (SELECT doc_id, {_SQL_MD} AS md FROM documents)
""",
)
def _plain(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.markdown_to_plain(_markdown()).alias("plain"))


@query(
    "strip_front_matter",
    f"SELECT doc_id, regexp_replace(md, '^---\\n(?:.|\\n)*?\\n---\\n*', '') AS body FROM (SELECT doc_id, {_SQL_MD} AS md FROM documents)",
)
def _front(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.strip_front_matter(_markdown()).alias("body"))


@query("strip_fences", f"SELECT doc_id, {sql_trim('text')} AS body FROM documents")
def _fences(t: Tables) -> DataFrame:
    fenced = F.concat(F.lit("```markdown\n"), "text", F.lit("\n```"))
    return t.documents.select("doc_id", tx.strip_fences(fenced).alias("body"))


_BOLD = r"regexp_replace(replace(text, '. ', '. **b** '), '\*\*([^*]+)\*\*', chr(1) || '\1' || chr(2), 'g')"


@query(
    "bold_spans",
    f"""
WITH parts AS (SELECT doc_id, unnest(string_split({_BOLD}, chr(1))) AS part, generate_subscripts(string_split({_BOLD}, chr(1)), 1) AS k FROM documents),
sizes AS (SELECT doc_id, k, length(split_part(part, chr(2), 1)) AS inner_size, length(replace(part, chr(2), '')) AS size FROM parts),
places AS (SELECT doc_id, k, inner_size, sum(size) OVER (PARTITION BY doc_id ORDER BY k) - size AS start, sum(size) OVER (PARTITION BY doc_id) AS n FROM sizes)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, k - 2 AS i, CAST(start AS BIGINT) AS start, CAST(start + inner_size AS BIGINT) AS "end" FROM places WHERE k > 1
""",
)
def _bold(t: Tables) -> DataFrame:
    bold = F.replace("text", F.lit(". "), F.lit(". **b** "))
    rows = t.documents.select("doc_id", tx.bold_spans(bold).alias("b"))
    spans = rows.select("doc_id", F.length("b.plain").alias("n_chars"), F.posexplode("b.spans").alias("i", "s"))
    return spans.select("doc_id", *[F.col(c).cast("bigint").alias(c.split(".")[-1]) for c in ("n_chars", "i", "s.start", "s.end")])


@query(
    "indent_paragraphs",
    f"""
SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\n+'), lambda p: {sql_trim('p')}), lambda p: p <> ''),
  lambda p: CASE WHEN regexp_matches(p, '^(?:\\t| {{4,}}|\\d+\\.\\s+[А-ЯЁA-Zа-яё]|\\d+\\.\\d+\\s+[А-ЯЁA-Zа-яё]|\\(\\d+\\)\\s|[•\\-—]\\s)') THEN p ELSE chr(9) || p END), chr(10) || chr(10)) AS body FROM documents
""",
)
def _indent(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.indent_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("body"))


@query(
    "normalize_tsv",
    f"""
SELECT doc_id, {sql_trim("regexp_replace(array_to_string(list_transform(string_split(replace(text, ' ', chr(9) || '  '), chr(10)), lambda l: array_to_string(list_transform(string_split(l, chr(9)), lambda c: trim(regexp_replace(c, '[ \\f\\v]+', ' ', 'g'))), chr(9))), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")} AS body FROM documents
""",
)
def _tsv(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.normalize_tsv(F.replace("text", F.lit(" "), F.lit("\t  "))).alias("body"))


@query(
    "shorten_error",
    f"""
SELECT doc_id, CASE WHEN lang = 'en' THEN 'quota' ELSE 'other' END AS kind, 'https://h.example.com/' || doc_id AS url,
  CASE WHEN length(flat) > 380 THEN substring(flat, 1, 380) || '…' ELSE flat END AS text
FROM (SELECT doc_id, lang, {sql_collapse("'https://h.example.com/' || doc_id || ': ' || CASE WHEN lang = 'en' THEN 'storageQuotaExceeded ' ELSE '' END || text")} AS flat FROM documents)
""",
)
def _error(t: Tables) -> DataFrame:
    message = F.concat(
        F.lit("https://h.example.com/"), F.col("doc_id").cast("string"), F.lit(": "), F.when(F.col("lang") == "en", "storageQuotaExceeded ").otherwise(""), "text"
    )
    return t.documents.select("doc_id", F.inline(F.array(tx.shorten_error(message))))


@query(
    "header_multiline",
    "SELECT c_custkey, c_name || chr(10) || 'Республика Беларусь' || CASE WHEN c_acctbal > 0 THEN ', г. Минск' ELSE '' END AS header FROM customer",
)
def _header(t: Tables) -> DataFrame:
    text = F.concat("c_name", F.lit(",  Республика Беларусь"), F.when(F.col("c_acctbal") > 0, ", г. Минск").otherwise(" "))
    return t.customer.select("c_custkey", tx.header_multiline(text).alias("header"))


@query(
    "customer_line",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_name ELSE c_mktsegment || ' ltd' END AS customer FROM customer",
)
def _customer_line(t: Tables) -> DataFrame:
    from docsluice.operators.cards import customer_line

    corpus = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("1. Наименование заказчика: "), "c_name", F.lit(" \nx"))).otherwise(
        F.concat(F.lit("Заказчик: указано в извещении\nОрганизатор закупки  "), "c_mktsegment", F.lit(" ltd"))
    )
    return t.customer.select("c_custkey", customer_line(corpus).alias("customer"))


@query(
    "canonical_download_name",
    "SELECT p_partkey, CASE WHEN p_size < 40 THEN p_type || '.pdf' ELSE p_type || '-20' || p_size || '.pdf' END AS name FROM part",
)
def _download_name(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    name = F.when(F.col("p_size") < 40, F.concat("p_type", F.lit("-"), size, F.lit(".pdf"))).otherwise(F.concat("p_type", F.lit("-20"), size, F.lit(".pdf")))
    return t.part.select("p_partkey", tx.canonical_download_name(name).alias("name"))


@query(
    "drive_id",
    """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE lpad(CAST(c_custkey AS VARCHAR), 12, 'x') END AS id FROM customer
""",
)
def _drive_id(t: Tables) -> DataFrame:
    from docsluice.functions.urls import drive_id

    key, segment = F.lpad(F.col("c_custkey").cast("string"), 12, "x"), F.col("c_mktsegment")
    link = (
        F.when(segment == "BUILDING", F.concat(F.lit("https://example.com/file/d/"), key))
        .when(segment == "AUTOMOBILE", F.concat(F.lit("https://drive.google.com/drive/folders/"), key, F.lit("?usp=sharing")))
        .when(segment == "MACHINERY", F.concat(F.lit("https://www.drive.google.com/open?id="), key))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("https://docs.google.com/document/d/"), key, F.lit("/edit#x")))
        .otherwise(F.concat(F.lit(" "), key))
    )
    return t.customer.select("c_custkey", drive_id(link).alias("id"))
