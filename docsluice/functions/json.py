"""JSON replies of models: lenient parsing to VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsluice.functions import text as tx

_LENIENT = {
    "allowSingleQuotes": "true",
    "allowUnquotedFieldNames": "true",
    "allowUnquotedControlChars": "true",
    "allowBackslashEscapingAnyCharacter": "true",
    "allowComments": "true",
    "mode": "PERMISSIVE",
}
_COMMAS = 8  # at most, before one bracket


def json_body(c: Column) -> Column:
    """The text between the outermost braces, fences removed."""

    def between(s: Column) -> Column:
        opened = F.instr(s, "{")
        behind = F.length(F.substring_index(s, "}", -1))  # behind the last closing brace; the whole text if there is none
        closed = F.length(s) - behind
        return F.when((opened > 0) & (closed > opened), F.substring(s, opened, closed - opened + 1)).otherwise(s)

    return tx.let(tx.strip_fences(c), between)


def without_trailing_commas(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?:,\s*+){{1,{_COMMAS}}}([}}\]])", "$1")


def lenient_json(c: Column) -> Column:
    """VARIANT of a model's reply: strict, without trailing commas, then with lenient syntax; NULL if nothing helps."""

    def parsed(body: Column) -> Column:
        def repaired(cleaned: Column) -> Column:
            return F.coalesce(F.try_parse_json(cleaned), F.from_json(cleaned, "variant", _LENIENT))

        return F.coalesce(F.try_parse_json(body), tx.let(without_trailing_commas(body), repaired))

    return tx.let(json_body(c), parsed)


def string_at(v: Column, path: str) -> Column:
    """A field that is a JSON string, trimmed; NULL for other types and for blanks."""

    def text(value: Column) -> Column:
        return tx.js_trim(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")))

    return tx.let(tx.let(F.try_variant_get(v, f"$.{path}", "variant"), text), lambda s: F.when(s != "", s))


def items_at(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
