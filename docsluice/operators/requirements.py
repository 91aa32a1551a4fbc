"""Parser results and requests: validation issues, snapshots with warnings, compliance matrices.

Documents are VARIANT columns, because the rules tell a JSON null from an absent field and one JSON type from another.
Every document keeps its own arrays; work on requirements happens on exploded rows, so no tender is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions import text as tx

# Messages of the validators, the matrix and the snapshot.
NEED_STRING = "Нужна непустая строка"
NEED_OBJECT = "Ожидался объект"
NEED_JSON_OBJECT = "Ожидался объект JSON"
NEED_ARRAY = "Ожидался массив"
NEED_SOURCE = "Нужен объект source с file, fragment и/или page"
BAD_SOURCE = "Некорректный source"
CRITERIA_ARRAY = "Если есть, criteria должен быть массивом"
META_OBJECT = "Если есть, meta должен быть объектом"
WANT_STRING = "Ожидалась строка"
WANT_STRINGS = "Ожидался массив строк"
NEED_URLS = "Нужен непустой массив строк (URL или идентификаторы документов)"
BLANK_URL = "Пустая строка недопустима"
NEED_LOCALE = "Нужна непустая строка (например ru)"
OPTIONS_OBJECT = "Если есть, options должен быть объектом"
UNKNOWN_FIELD = "Неизвестное поле"
WANT_BOOLEAN = "Ожидался boolean"
KNOWN_OPTIONS = ("extract_requirements", "extract_deadlines")
OPEN_STATUS = "open"
NO_EVIDENCE = "—"
REVIEW_NOTE = "needs_review: проверить вручную"



def parse_documents(docs: DataFrame, json: str = "json") -> DataFrame:
    """Add the parsed document; text that is not JSON gets NULL and one issue instead of stopping the batch."""
    return docs.withColumn("doc", F.try_parse_json(json))


def _kind(v: Column) -> Column:
    """JSON type of a variant: NULL when absent.  The value is looked up once, however many types are told apart."""

    def named(name: Column) -> Column:
        return (
            F.when(name.isNull(), F.lit(None))
            .when(name == "VOID", "null")
            .when(name.startswith("OBJECT"), "object")
            .when(name.startswith("ARRAY"), "array")
            .when(name == "STRING", "string")
            .when(name == "BOOLEAN", "boolean")
            .otherwise("number")
        )

    return tx.let(F.schema_of_variant(v), named)


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _is(v: Column, *kinds: str) -> Column:
    return F.coalesce(_kind(v).isin(*kinds), F.lit(False))


def _as_string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _non_blank_string(v: Column) -> Column:
    return _is(v, "string") & F.coalesce(tx.non_blank(_as_string(v)), F.lit(False))


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def source_ref_ok(v: Column) -> Column:
    """True if any of file (string), fragment (string), page (number) has its type; the others may be anything."""
    return _is(_get(v, "file"), "string") | _is(_get(v, "fragment"), "string") | _is(_get(v, "page"), "number")


def _issue(path: Column | str, message: str) -> Column:
    return F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(message).alias("message"))


def _fired(*rules: tuple[Column, Column]) -> Column:
    """Issues whose condition holds, in rule order."""
    return F.filter(F.array(*[F.when(bad, issue) for bad, issue in rules]), lambda x: x.isNotNull())


def _at(field: str, i: Column, leaf: str = "") -> Column:
    return F.concat(F.lit(f"{field}["), i.cast("string"), F.lit("]" + leaf))


def _per_item(v: Column, rules) -> Column:
    """Issues of every element; ``rules(element, index)`` gives the issues of one."""
    items = _items(v)
    return F.flatten(F.transform(items, lambda item, i: rules(item, i)))


def _named_item_rules(field: str, text_field: str):
    def rules(item: Column, i: Column) -> Column:
        broken = ~_is(item, "object", "array")
        return F.when(broken, F.array(_issue(_at(field, i), NEED_OBJECT))).otherwise(
            _fired(
                (~_non_blank_string(_get(item, "id")), _issue(_at(field, i, ".id"), NEED_STRING)),
                (~_non_blank_string(_get(item, text_field)), _issue(_at(field, i, f".{text_field}"), NEED_STRING)),
                (~source_ref_ok(_get(item, "source")), _issue(_at(field, i, ".source"), NEED_SOURCE)),
            )
        )

    return rules


def _criterion_rules(item: Column, i: Column) -> Column:
    source = _get(item, "source")
    return (
        F.when(~_is(item, "object", "array"), F.array(_issue(_at("criteria", i), NEED_OBJECT)))
        .when(~_non_blank_string(_get(item, "raw")), F.array(_issue(_at("criteria", i, ".raw"), NEED_STRING)))
        .when(
            source.isNotNull() & ~source_ref_ok(source), F.array(_issue(_at("criteria", i, ".source"), BAD_SOURCE))
        )
        .otherwise(_fired((F.lit(False), _issue("", ""))))
    )


def result_issues(doc: Column) -> Column:
    """Array of (path, message) for a parser result; every broken rule is listed."""
    meta = _get(doc, "meta")
    warnings = _get(meta, "warnings")
    bad_warnings = ~_is(warnings, "array") | F.exists(_items(warnings), lambda w: ~_is(w, "string"))
    version = _get(meta, "parser_version")
    meta_object = _is(meta, "object", "array")
    criteria = _get(doc, "criteria")

    def array_rule(field: str, present: Column, message: str) -> tuple[Column, Column]:
        return present & ~_is(_get(doc, field), "array"), _issue(field, message)

    body = F.concat(
        _fired((~_non_blank_string(_get(doc, "tender_id")), _issue("tender_id", NEED_STRING))),
        _fired(array_rule("requirements", F.lit(True), NEED_ARRAY)),
        _per_item(_get(doc, "requirements"), _named_item_rules("requirements", "text")),
        _fired(array_rule("deadlines", F.lit(True), NEED_ARRAY)),
        _per_item(_get(doc, "deadlines"), _named_item_rules("deadlines", "label")),
        _fired(array_rule("criteria", criteria.isNotNull(), CRITERIA_ARRAY)),
        _per_item(criteria, _criterion_rules),
        _fired(
            (meta.isNotNull() & ~meta_object, _issue("meta", META_OBJECT)),
            (meta_object & version.isNotNull() & ~_is(version, "string"), _issue("meta.parser_version", WANT_STRING)),
            (meta_object & warnings.isNotNull() & bad_warnings, _issue("meta.warnings", WANT_STRINGS)),
        ),
    )
    return F.when(_is(doc, "object", "array"), body).otherwise(F.array(_issue("", NEED_JSON_OBJECT)))


def request_issues(doc: Column) -> Column:
    """Array of (path, message) for a parse request."""
    urls, options = _get(doc, "document_urls"), _get(doc, "options")
    items = _items(urls)
    bad_urls = ~_is(urls, "array") | (F.size(items) == 0) | F.exists(items, lambda u: ~_is(u, "string"))
    blank = F.filter(
        F.transform(items, lambda u, i: F.when(~tx.non_blank(_as_string(u)), _issue(_at("document_urls", i), BLANK_URL))),
        lambda x: x.isNotNull(),
    )
    is_object = _is(options, "object", "array")
    keys = F.coalesce(F.map_keys(F.try_variant_get(options, "$", "map<string,variant>")), F.array().cast("array<string>"))
    unknown = F.transform(
        F.filter(keys, lambda k: ~k.isin(*KNOWN_OPTIONS)),
        lambda k: _issue(F.concat(F.lit("options."), k), UNKNOWN_FIELD),
    )

    def option_rule(name: str) -> tuple[Column, Column]:
        value = _get(options, name)
        return is_object & value.isNotNull() & ~_is(value, "boolean"), _issue(f"options.{name}", WANT_BOOLEAN)

    body = F.concat(
        _fired((~_non_blank_string(_get(doc, "tender_id")), _issue("tender_id", NEED_STRING))),
        F.when(bad_urls, F.array(_issue("document_urls", NEED_URLS))).otherwise(blank),
        _fired(
            (~_non_blank_string(_get(doc, "locale")), _issue("locale", NEED_LOCALE)),
            (options.isNotNull() & ~is_object, _issue("options", OPTIONS_OBJECT)),
        ),
        unknown,
        _fired(*[option_rule(name) for name in KNOWN_OPTIONS]),
    )
    return F.when(_is(doc, "object", "array"), body).otherwise(F.array(_issue("", NEED_JSON_OBJECT)))


def validate(docs: DataFrame, issues, key: str = "doc_id") -> DataFrame:
    """(key, ord, path, message) rows of all documents; ``issues`` is one of the two rule sets."""
    found = docs.select(key, F.posexplode(issues(F.col("doc"))).alias("ord", "issue"))
    return found.select(key, "ord", "issue.path", "issue.message")


def with_issues(docs: DataFrame, issues, key: str = "doc_id") -> DataFrame:
    """(key, ord, path, message) as ``validate`` gives them, and one row of NULLs for a document without an issue.

    Documents are read once; a join of all of them with their issues would read them twice.
    """
    found = docs.select(key, F.posexplode_outer(tx.let(F.col("doc"), issues)).alias("ord", "issue"))
    return found.select(key, "ord", "issue.path", "issue.message")


def accept_valid(docs: DataFrame, issues, key: str = "doc_id") -> DataFrame:
    """Documents without a single issue: a row filter, since all rules of a document look at that document alone.

    The filter sinks below the column it reads, so every use of ``doc`` would parse the text anew; ``let`` parses it once.
    """
    return docs.where(F.size(tx.let(F.col("doc"), issues)) == 0)


def _source(v: Column) -> Column:
    page = _get(v, "page")
    return F.struct(
        F.try_variant_get(v, "$.file", "string").alias("file"),
        F.try_variant_get(v, "$.fragment", "string").alias("fragment"),
        F.when(_is(page, "number"), F.try_variant_get(page, "$", "double")).alias("page"),
    )


def _typed(item: Column, field: str, kind: str, to: str) -> Column:
    value = _get(item, field)
    return F.when(_is(value, kind), F.try_variant_get(value, "$", to))


def _trimmed(item: Column, field: str) -> Column:
    return tx.js_trim(F.try_variant_get(item, f"$.{field}", "string"))


def requirement_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Valid results → (key, tender_id, pos, id, text, source, confidence, needs_review), in input order."""
    rows = docs.select(
        key,
        _trimmed(F.col("doc"), "tender_id").alias("tender_id"),
        F.posexplode(_items(_get(F.col("doc"), "requirements"))).alias("pos", "r"),
    )
    r = F.col("r")
    return rows.select(
        key,
        "tender_id",
        "pos",
        _trimmed(r, "id").alias("id"),
        _trimmed(r, "text").alias("text"),
        _source(_get(r, "source")).alias("source"),
        _typed(r, "confidence", "number", "double").alias("confidence"),
        _typed(r, "needs_review", "boolean", "boolean").alias("needs_review"),
    )


def deadline_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Valid results → deadlines; the date stays text, with a parsed timestamp beside it."""
    rows = docs.select(key, F.posexplode(_items(_get(F.col("doc"), "deadlines"))).alias("pos", "d"))
    d = F.col("d")
    when = F.nullif(tx.js_trim(_typed(d, "datetime", "string", "string")), F.lit(""))
    return rows.select(
        key,
        "pos",
        _trimmed(d, "id").alias("id"),
        _trimmed(d, "label").alias("label"),
        when.alias("datetime"),
        F.try_to_timestamp(when).alias("datetime_at"),
        _source(_get(d, "source")).alias("source"),
        _typed(d, "needs_review", "boolean", "boolean").alias("needs_review"),
    )


def criterion_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    rows = docs.select(key, F.posexplode(_items(_get(F.col("doc"), "criteria"))).alias("pos", "c"))
    c = F.col("c")
    source = _get(c, "source")
    return rows.select(
        key,
        "pos",
        _trimmed(c, "raw").alias("raw"),
        F.when(source.isNotNull(), _source(source)).alias("source"),
        _typed(c, "needs_review", "boolean", "boolean").alias("needs_review"),
    )


def meta_warnings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    warnings = _items(_get(_get(F.col("doc"), "meta"), "warnings"))
    rows = docs.select(key, _trimmed(F.col("doc"), "tender_id").alias("tender_id"), F.posexplode(warnings).alias("pos", "w"))
    return rows.select(key, "tender_id", "pos", _as_string(F.col("w")).alias("warning"))


def duplicate_ids(rows: DataFrame, group: list[str], order: str = "pos") -> DataFrame:
    """Every row after the first of its group.

    The first is a minimum, combined before the shuffle; a row-number window would sort a hot id in one task.
    """
    first = rows.groupBy(*group).agg(F.min(order).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    return rows.join(first, group).where(F.col(order) > F.col("first")).drop("first", "n")


def snapshot_warnings(requirements: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(tender_id, section, sort_id, pos, warning): given warnings, then duplicates by id, then per requirement.

    ``section, sort_id, pos, line`` is the order of the lines within a tender.
    """
    repeated = duplicate_ids(requirements.select("tender_id", "id", "pos"), ["tender_id", "id"])
    parts = [
        repeated.select(
            "tender_id",
            F.lit(1).alias("section"),
            F.col("id").alias("sort_id"),
            "pos",
            F.lit(0).alias("line"),
            F.concat(F.lit("Дублируется requirement id: "), "id").alias("warning"),
        )
    ]
    lines = F.array(
        F.when(F.col("needs_review"), F.concat(F.lit("Требование "), "id", F.lit(" помечено needs_review"))),
        F.when(
            F.col("confidence") < 0.5,
            F.concat(
                F.lit("Требование "), "id", F.lit(": низкая уверенность ("), tx.js_number(F.col("confidence")), F.lit(")")
            ),
        ),
    )
    per_row = requirements.select("tender_id", "id", "pos", F.posexplode(lines).alias("line", "warning"))
    parts.append(
        per_row.where(F.col("warning").isNotNull()).select(
            "tender_id", F.lit(2).alias("section"), F.lit("").alias("sort_id"), "pos", "line", "warning"
        )
    )
    if given is not None:
        parts.append(
            given.select(
                "tender_id", F.lit(0).alias("section"), F.lit("").alias("sort_id"), "pos", F.lit(0).alias("line"), "warning"
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compliance_matrix(requirements: DataFrame) -> DataFrame:
    """One open row per requirement with a note on what to check."""
    confidence = F.col("confidence")
    return requirements.select(
        "tender_id",
        F.col("id").alias("requirement_id"),
        F.col("text").alias("requirement_text"),
        F.lit(OPEN_STATUS).alias("status"),
        F.lit(NO_EVIDENCE).alias("evidence_ref"),
        F.when(F.col("needs_review"), REVIEW_NOTE)
        .when(confidence < 0.8, F.concat(F.lit("confidence="), tx.js_number(confidence)))
        .alias("notes"),
    )
