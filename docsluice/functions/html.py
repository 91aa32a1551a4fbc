"""HTML expressions: pages are text, and what is needed from them is reached with a few linear patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsluice.functions import text as tx

_INVISIBLE = r"script[\s\S]*?</script|style[\s\S]*?</style"
_LINE_END = r"(?i)<(?:br\s*/?|/(?:p|div|tr|li|h[1-6])\s*)>"
_TAG = r"<[^>]+>"


def strip_comments(html: Column) -> Column:
    """Drop HTML and script comments, which otherwise leak into the text."""
    return F.regexp_replace(F.regexp_replace(html, r"<!--[\s\S]*?-->", " "), r"/\*[\s\S]*?\*/", " ")


def character(code: Column) -> Column:
    """The character of a decimal code point given as text; lone surrogates become the replacement character."""
    surrogate = code.cast("bigint").between(0xD800, 0xDFFF)
    code = F.when(surrogate, str(0xFFFD)).otherwise(code)
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")


def decode_numeric_refs(c: Column) -> Column:
    """Replace ``&#NNN;``; each distinct reference is replaced once in the whole text."""
    codes = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#(\d{1,6});"), F.lit(1)))

    def put(acc: Column, code: Column) -> Column:
        return F.replace(acc, F.concat(F.lit("&#"), code, F.lit(";")), character(code))

    return F.when(c.contains("&#"), F.aggregate(codes, c, put)).otherwise(c)


def decode_entities(c: Column) -> Column:
    """nbsp, amp, lt, gt, quot and decimal references, in this order."""
    out = F.regexp_replace(c, "(?i)&nbsp;", " ")
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        out = F.replace(out, F.lit(name), F.lit(char))
    return decode_numeric_refs(out)


def strip_tags(c: Column) -> Column:
    return tx.collapse_ws(F.regexp_replace(c, _TAG, " "))


def strip_html(html: Column) -> Column:
    """One-line text of a page or fragment; line ends of any kind become blanks, so one pass removes all markup."""
    return tx.let(html, strip_cell)


def strip_cell(html: Column) -> Column:
    """``strip_html`` of a value that costs nothing to read again, as a lambda's; without markup it passes by the patterns."""
    out = F.regexp_replace(html, rf"(?i)<(?:{_INVISIBLE}|[^>]+)>", " ")
    out = F.replace(F.regexp_replace(out, "(?i)&nbsp;", " "), F.lit("&amp;"), F.lit("&"))
    marked = html.contains("<") | html.contains("&")
    return tx.collapse_ws(F.when(marked, tx.let(out, decode_numeric_refs)).otherwise(html))


def strip_html_lines(html: Column) -> Column:
    """Text of a page with its line structure kept."""
    out = F.regexp_replace(html, rf"(?i)<(?:{_INVISIBLE})>", "")
    out = F.regexp_replace(F.regexp_replace(out, _LINE_END, "\n"), _TAG, " ")
    out = F.regexp_replace(F.replace(out, F.lit("\r\n"), F.lit("\n")), r"[ \t\f\x0B]+", " ")
    return tx.js_trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def fragments(html: Column, pattern: str, group: int = 1) -> Column:
    r"""All matches of a case-insensitive pattern without plain dots, as text; any character is written ``[\s\S]``, which
    the engine tests faster as a dot."""
    return F.regexp_extract_all(html, F.lit("(?is)" + pattern.replace(r"[\s\S]", ".")), F.lit(group))


def headings(html: Column) -> Column:
    found = F.transform(fragments(html, r"<h([1-3])\b[^>]*>([\s\S]*?)</h\1>", 2), strip_html)
    return F.filter(found, lambda t: F.length(t) >= 2)


def title_tag(html: Column) -> Column:
    return strip_html(F.regexp_extract(html, r"(?i)<title[^>]*>([\s\S]*?)</title>", 1))


def meta_content(html: Column, prop: str) -> Column:
    """Content of a meta tag, its name before or after the content; '' if there is none."""
    named = rf"(?:property|name)\s*=\s*[\"']{prop}[\"']"
    value = r"content\s*=\s*[\"']([^\"']*)[\"']"
    first = F.regexp_extract(html, rf"(?i)<meta[^>]+{named}[^>]+{value}", 1)
    second = F.regexp_extract(html, rf"(?i)<meta[^>]+{value}[^>]+{named}", 1)
    raw = F.trim(F.when(first != "", first).otherwise(second))
    return decode_numeric_refs(F.replace(F.replace(raw, F.lit("&amp;"), F.lit("&")), F.lit("&quot;"), F.lit('"')))


def anchors(html: Column) -> Column:
    """Array of (href, inner) of all anchors with a href, in page order."""
    pattern = r"<a\b[^>]*?\bhref\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)[^>]*>[\s\S]*?</a>"
    href = r"(?i)^<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"

    def one(a: Column) -> Column:
        raw = F.concat(*[F.regexp_extract(a, href, g) for g in (1, 2, 3)])
        return F.struct(
            tx.js_trim(raw).alias("href"), F.regexp_extract(a, r"^<[^>]*>([\s\S]*)</[aA]>$", 1).alias("inner")
        )

    return F.transform(fragments(html, pattern, 0), one)
