"""Queries of parser results over ``documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions import text as tx
from docsluice.operators import requirements as rq
from docsluice.plans.registry import Tables, query

# Each document becomes one parser result and one request.  What is wrong with them follows from its language, length
# and labels, so every rule fires somewhere in the data.
_WORDS = "trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))"
_SQL_JSON = f"""
SELECT doc_id, '{{"tender_id":' || CASE WHEN lang = 'de' THEN '"  "' WHEN lang = 'fr' THEN '" ' || source || ' "' ELSE '"' || source || '"' END
  || ',"requirements":' || CASE WHEN quality IS NULL AND toxic IS NULL AND lang = 'es' THEN '{{}}' ELSE
     '[{{"id":"R1","text":"' || words || '","source":' || CASE WHEN n_chars > 3000 THEN '{{"page":"3"}}' ELSE '{{"file":"a.pdf","page":12}}' END
     || ',"confidence":' || (n_chars / 10000.0)::DOUBLE || ',"needs_review":' || CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END
     || '}},' || CASE WHEN n_chars < 300 THEN 'null' ELSE '{{"id":7,"text":"' || CASE WHEN n_chars < 900 THEN '' ELSE 'x' END || '","source":{{"fragment":"f"}}}}' END || ']' END
  || ',"deadlines":[{{"id":"D1","label":"' || lang || '","source":{{"page":1}},"datetime":" 2024-01-0' || (length(lang) + 1) || ' "}}]'
  || CASE WHEN quality = 0 THEN ',"criteria":[{{"raw":"' || lang || '","source":null}}]' ELSE '' END
  || CASE WHEN quality = 1 THEN ',"meta":{{"parser_version":1,"warnings":["w",2]}}' WHEN quality = 0 THEN ',"meta":null'
     ELSE ',"meta":{{"warnings":["given"]}}' END || '}}' AS json
FROM (SELECT *, {_WORDS} AS words FROM documents LEFT JOIN labels USING (doc_id))"""


def result_documents(t: Tables) -> DataFrame:
    rows = t.spread("documents", "doc_id", "lang", "source", "n_chars", "text").join(t.labels, "doc_id", "left")
    words = F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " "))
    q = F.col("quality")
    n = F.col("n_chars")
    first = F.concat(
        F.lit('[{"id":"R1","text":"'), words, F.lit('","source":'),
        F.when(n > 3000, '{"page":"3"}').otherwise('{"file":"a.pdf","page":12}'),
        F.lit(',"confidence":'), (n / 10000.0).cast("double").cast("string"),
        F.lit(',"needs_review":'), F.when(F.col("toxic") == 1, "true").otherwise("false"), F.lit("},"),
        F.when(n < 300, "null").otherwise(
            F.concat(F.lit('{"id":7,"text":"'), F.when(n < 900, "").otherwise("x"), F.lit('","source":{"fragment":"f"}}'))
        ),
        F.lit("]"),
    )
    no_label = q.isNull() & F.col("toxic").isNull()
    json = F.concat(
        F.lit('{"tender_id":'),
        F.when(F.col("lang") == "de", '"  "')
        .when(F.col("lang") == "fr", F.concat(F.lit('" '), "source", F.lit(' "')))
        .otherwise(F.concat(F.lit('"'), "source", F.lit('"'))),
        F.lit(',"requirements":'),
        F.when(no_label & (F.col("lang") == "es"), "{}").otherwise(first),
        F.lit(',"deadlines":[{"id":"D1","label":"'), "lang", F.lit('","source":{"page":1},"datetime":" 2024-01-0'),
        (F.length("lang") + 1).cast("string"), F.lit(' "}]'),
        F.when(q == 0, F.concat(F.lit(',"criteria":[{"raw":"'), "lang", F.lit('","source":null}]'))).otherwise(""),
        F.when(q == 1, ',"meta":{"parser_version":1,"warnings":["w",2]}').when(q == 0, ',"meta":null').otherwise(
            ',"meta":{"warnings":["given"]}'
        ),
        F.lit("}"),
    )
    return rq.parse_documents(rows.select("doc_id", json.alias("json")))


def _sql_rule(path: str, message: str, condition: str) -> str:
    return f"SELECT doc_id, '{path}' AS path, '{message}' AS message FROM j WHERE {condition}"


def _sql_blank(path: str) -> str:
    return f"(coalesce(json_type(json, '{path}'), 'NULL') <> 'VARCHAR' OR trim(json_extract_string(json, '{path}')) = '')"


def _sql_no_source(path: str) -> str:
    return (
        f"NOT (coalesce(json_type(json, '{path}.file'), '') = 'VARCHAR' OR coalesce(json_type(json, '{path}.fragment'), '') = 'VARCHAR'"
        f" OR coalesce(json_type(json, '{path}.page'), '') IN ('UBIGINT', 'BIGINT', 'DOUBLE'))"
    )


def _sql_result_issues() -> str:
    parts = [
        _sql_rule("tender_id", rq.NEED_STRING, _sql_blank("$.tender_id")),
        _sql_rule("requirements", rq.NEED_ARRAY, "coalesce(json_type(json, '$.requirements'), '') <> 'ARRAY'"),
    ]
    for i in range(2):
        item = f"$.requirements[{i}]"
        there = f"json_type(json, '{item}') IS NOT NULL"
        is_object = f"json_type(json, '{item}') = 'OBJECT'"
        parts += [
            _sql_rule(f"requirements[{i}]", rq.NEED_OBJECT, f"{there} AND NOT {is_object}"),
            _sql_rule(f"requirements[{i}].id", rq.NEED_STRING, f"{is_object} AND {_sql_blank(item + '.id')}"),
            _sql_rule(f"requirements[{i}].text", rq.NEED_STRING, f"{is_object} AND {_sql_blank(item + '.text')}"),
            _sql_rule(f"requirements[{i}].source", rq.NEED_SOURCE, f"{is_object} AND {_sql_no_source(item + '.source')}"),
        ]
    source = "$.criteria[0].source"
    parts += [
        _sql_rule("criteria[0].source", rq.BAD_SOURCE, f"json_type(json, '{source}') IS NOT NULL AND {_sql_no_source(source)}"),
        _sql_rule("meta", rq.META_OBJECT, "json_type(json, '$.meta') = 'NULL'"),
        _sql_rule("meta.parser_version", rq.WANT_STRING, "coalesce(json_type(json, '$.meta.parser_version'), 'VARCHAR') <> 'VARCHAR'"),
        _sql_rule("meta.warnings", rq.WANT_STRINGS, "json_type(json, '$.meta.warnings[1]') = 'UBIGINT'"),
    ]
    return f"WITH j AS ({_SQL_JSON}) " + " UNION ALL ".join(parts)


_SQL_DEADLINES = """
SELECT doc_id, '{"tender_id":"t","requirements":[],"deadlines":[' || CASE WHEN n_chars < 400 THEN '7' WHEN lang = 'fr' THEN '{"id":"D","label":5,"source":{"page":1}}'
  WHEN lang = 'de' THEN '{"id":"D","label":"l","source":{"page":"1"}}' WHEN lang = 'es' THEN '{"id":" ","label":"l"}' ELSE '{"id":"D","label":"l","source":{"fragment":"f"}}' END
  || '],"meta":{"warnings":[]}}' AS json FROM documents"""
_DEADLINE = "$.deadlines[0]"


@query(
    "validate_deadlines",
    f"WITH j AS ({_SQL_DEADLINES}) "
    + " UNION ALL ".join(
        _sql_rule(f"deadlines[0]{path}", message, condition)
        for path, message, condition in (
            ("", rq.NEED_OBJECT, f"json_type(json, '{_DEADLINE}') <> 'OBJECT'"),
            (".id", rq.NEED_STRING, f"json_type(json, '{_DEADLINE}') = 'OBJECT' AND {_sql_blank(_DEADLINE + '.id')}"),
            (".label", rq.NEED_STRING, f"json_type(json, '{_DEADLINE}') = 'OBJECT' AND {_sql_blank(_DEADLINE + '.label')}"),
            (".source", rq.NEED_SOURCE, f"json_type(json, '{_DEADLINE}') = 'OBJECT' AND {_sql_no_source(_DEADLINE + '.source')}"),
        )
    ),
)
def _validate_deadlines(t: Tables) -> DataFrame:
    """Results whose deadline breaks one rule or another."""
    lang = F.col("lang")
    deadline = (
        F.when(F.col("n_chars") < 400, "7").when(lang == "fr", '{"id":"D","label":5,"source":{"page":1}}').when(lang == "de", '{"id":"D","label":"l","source":{"page":"1"}}')
        .when(lang == "es", '{"id":" ","label":"l"}').otherwise('{"id":"D","label":"l","source":{"fragment":"f"}}')
    )
    json = F.concat(F.lit('{"tender_id":"t","requirements":[],"deadlines":['), deadline, F.lit('],"meta":{"warnings":[]}}'))
    parsed = rq.parse_documents(t.spread("documents", "doc_id", "lang", "n_chars").select("doc_id", json.alias("json")))
    return rq.validate(parsed, rq.result_issues).select("doc_id", "path", "message")


@query("validate_results", _sql_result_issues())
def _validate_results(t: Tables) -> DataFrame:
    return rq.validate(result_documents(t), rq.result_issues).select("doc_id", "path", "message")


@query(
    "accept_valid",
    f"SELECT doc_id FROM ({_SQL_JSON}) WHERE doc_id NOT IN (SELECT doc_id FROM ({_sql_result_issues()}))",
)
def _accept(t: Tables) -> DataFrame:
    return rq.accept_valid(result_documents(t), rq.result_issues).select("doc_id")


@query(
    "normalize_results",
    f"""
SELECT doc_id, trim(json_extract_string(json, '$.tender_id')) AS tender_id, pos,
       CASE WHEN json_type(r, '$.id') = 'VARCHAR' THEN json_extract_string(r, '$.id') ELSE CAST(json_extract(r, '$.id') AS VARCHAR) END AS id,
       json_extract_string(r, '$.text') AS text, json_extract_string(r, '$.source.file') AS file,
       CASE WHEN json_type(r, '$.source.page') = 'UBIGINT' THEN CAST(json_extract_string(r, '$.source.page') AS DOUBLE) END AS page,
       CAST(json_extract_string(r, '$.confidence') AS DOUBLE) AS confidence,
       CAST(json_extract_string(r, '$.needs_review') AS BOOLEAN) AS needs_review
FROM (SELECT doc_id, json, unnest(CASE WHEN json_type(json, '$.requirements') = 'ARRAY' THEN json_extract(json, '$.requirements[*]') ELSE [] END) AS r,
             unnest(CASE WHEN json_type(json, '$.requirements') = 'ARRAY' THEN [0, 1] ELSE [] END)::BIGINT AS pos FROM ({_SQL_JSON}))
""",
)
def _normalize(t: Tables) -> DataFrame:
    rows = rq.requirement_rows(result_documents(t))
    return rows.select(
        "doc_id", "tender_id", F.col("pos").cast("bigint").alias("pos"), "id", "text",
        F.col("source.file").alias("file"), F.col("source.page").alias("page"), "confidence", "needs_review",
    )


_SQL_REQUEST = """
SELECT doc_id, '{"tender_id":"' || CASE WHEN lang = 'es' THEN ' ' ELSE source END || '","document_urls":'
  || CASE WHEN n_chars > 6000 THEN '[]' WHEN n_chars > 3000 THEN '"u"' ELSE '["' || lang || '","' || CASE WHEN n_chars < 700 THEN ' ' ELSE 'b' END || '"]' END
  || ',"locale":"' || CASE WHEN lang = 'de' THEN '' ELSE lang END || '"'
  || CASE WHEN quality = 1 THEN ',"options":{"extract_deadlines":"no","extra_' || lang || '":1}' WHEN quality = 0 THEN ',"options":null' ELSE '' END || '}' AS json,
  lang, n_chars, quality
FROM documents LEFT JOIN labels USING (doc_id)"""


def request_documents(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    lang, n, q = F.col("lang"), F.col("n_chars"), F.col("quality")
    json = F.concat(
        F.lit('{"tender_id":"'), F.when(lang == "es", " ").otherwise(F.col("source")), F.lit('","document_urls":'),
        F.when(n > 6000, "[]").when(n > 3000, '"u"').otherwise(
            F.concat(F.lit('["'), lang, F.lit('","'), F.when(n < 700, " ").otherwise("b"), F.lit('"]'))
        ),
        F.lit(',"locale":"'), F.when(lang == "de", "").otherwise(lang), F.lit('"'),
        F.when(q == 1, F.concat(F.lit(',"options":{"extract_deadlines":"no","extra_'), lang, F.lit('":1}')))
        .when(q == 0, ',"options":null')
        .otherwise(""),
        F.lit("}"),
    )
    return rq.parse_documents(rows.select("doc_id", json.alias("json")))


@query(
    "validate_requests",
    f"""
WITH j AS ({_SQL_REQUEST})
{_sql_rule("tender_id", rq.NEED_STRING, _sql_blank("$.tender_id"))}
UNION ALL {_sql_rule("document_urls", rq.NEED_URLS, "json_type(json, '$.document_urls') <> 'ARRAY' OR json_array_length(json, '$.document_urls') = 0")}
UNION ALL {_sql_rule("document_urls[1]", rq.BLANK_URL, "trim(json_extract_string(json, '$.document_urls[1]')) = ''")}
UNION ALL {_sql_rule("locale", rq.NEED_LOCALE, _sql_blank("$.locale"))}
UNION ALL {_sql_rule("options", rq.OPTIONS_OBJECT, "json_type(json, '$.options') = 'NULL'")}
UNION ALL SELECT doc_id, 'options.extra_' || lang, '{rq.UNKNOWN_FIELD}' FROM j WHERE quality = 1
UNION ALL {_sql_rule("options.extract_deadlines", rq.WANT_BOOLEAN, "json_type(json, '$.options.extract_deadlines') = 'VARCHAR'")}
""",
)
def _validate_requests(t: Tables) -> DataFrame:
    return rq.validate(request_documents(t), rq.request_issues).select("doc_id", "path", "message")


def requirements_table(t: Tables) -> DataFrame:
    """A flat requirement per labelled document; the id repeats where languages and lengths coincide.

    The confidence is rounded as a double, as the SQL does: a hundredfold first, so 0.145 (stored below that) is 0.14.
    """
    joined = t.documents.join(t.labels, "doc_id")
    return joined.select(
        F.col("source").alias("tender_id"),
        F.col("doc_id").alias("pos"),
        F.concat("lang", F.lit("-"), F.floor(F.col("n_chars") / 500).cast("string")).alias("id"),
        tx.js_trim(F.col("text")).alias("text"),
        (F.round(F.least(F.lit(1.0), F.col("n_chars") / 5000) * 100) / 100).alias("confidence"),
        (F.col("toxic") == 1).alias("needs_review"),
    )


_SQL_REQS = """
SELECT source AS tender_id, doc_id AS pos, lang || '-' || CAST(floor(n_chars / 500) AS BIGINT) AS id, text,
       round(least(1.0, n_chars / 5000), 2)::DOUBLE AS confidence, toxic = 1 AS needs_review
FROM documents JOIN labels USING (doc_id)"""
_SQL_CONF = "CASE WHEN confidence = floor(confidence) THEN CAST(CAST(confidence AS BIGINT) AS VARCHAR) ELSE CAST(confidence AS VARCHAR) END"


@query(
    "duplicate_ids",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, min(l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey) OVER (PARTITION BY l_orderkey) AS first FROM lineitem)
WHERE l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey > first
""",
)
def _duplicates(t: Tables) -> DataFrame:
    place = (
        F.col("l_linenumber") * F.lit(100_000_000).cast("bigint")
        + F.col("l_partkey") * F.lit(1000).cast("bigint")
        + F.col("l_suppkey")
    )
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", place.alias("pos"))
    return rq.duplicate_ids(rows, ["l_orderkey"]).drop("pos")


@query(
    "snapshot_warnings",
    f"""
WITH r AS ({_SQL_REQS})
SELECT tender_id, 1 AS section, id AS sort_id, pos, 0 AS line, 'Дублируется requirement id: ' || id AS warning
FROM (SELECT *, row_number() OVER (PARTITION BY tender_id, id ORDER BY pos) AS n FROM r) WHERE n > 1
UNION ALL SELECT tender_id, 2, '', pos, 0, 'Требование ' || id || ' помечено needs_review' FROM r WHERE needs_review
UNION ALL SELECT tender_id, 2, '', pos, 1, 'Требование ' || id || ': низкая уверенность (' || {_SQL_CONF} || ')' FROM r WHERE confidence < 0.5
""",
)
def _warnings(t: Tables) -> DataFrame:
    return rq.snapshot_warnings(requirements_table(t))


@query(
    "compliance_matrix",
    f"""
SELECT tender_id, id AS requirement_id, text AS requirement_text, 'open' AS status, '—' AS evidence_ref,
       CASE WHEN needs_review THEN 'needs_review: проверить вручную' WHEN confidence < 0.8 THEN 'confidence=' || {_SQL_CONF} END AS notes
FROM ({_SQL_REQS.replace("text,", "regexp_replace(text, '^[ \\n\\t\\r]+|[ \\n\\t\\r]+$', '', 'g') AS text,", 1)})
""",
)
def _matrix(t: Tables) -> DataFrame:
    return rq.compliance_matrix(requirements_table(t))
