"""Text expressions.  Lengths are counted in code points."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsluice.functions.patterns import WS, WS_LIST, matches

CHUNK_CHARS = 3500


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def decode_utf8(content: Column) -> Column:
    """Bytes as text; malformed sequences become replacement characters instead of failing the job."""
    return F.make_valid_utf8(content.cast("string"))


def js_trim(c: Column) -> Column:
    """Trim every kind of white space, not just U+0020."""
    return F.btrim(c, F.lit(WS_LIST))


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def uniform_quotes(c: Column) -> Column:
    """Quotes and apostrophes of every kind as the plain ones; texts of ASCII alone hold no other kind."""
    return F.when(is_ascii(c), c).otherwise(F.translate(c, "«»„“”’′", "\"\"\"\"\"''"))


def normalize_evidence(c: Column) -> Column:
    """Unify quotes and apostrophes, then collapse blanks: the form in which quotes are searched.

    No-break spaces become plain ones first; most texts are then of ASCII with single blanks and meet no pattern.
    """
    def read(x: Column) -> Column:
        odd = reduce(lambda a, b: a | b, [F.contains(x, F.lit(run)) for run in ("  ", "\t", "\n", "\r", "\f", "\v")])
        return F.when(is_ascii(x) & ~odd, F.trim(x)).otherwise(collapse_ws(uniform_quotes(x)))

    return let(F.replace(c, F.lit("\u00a0"), F.lit(" ")), read)


def truncate_marked(c: Column, limit: int, marker: str) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(marker))).otherwise(c)


def js_number(c: Column) -> Column:
    """A double as JSON prints it: whole numbers without a fraction, small exponent."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    plain = F.regexp_replace(F.regexp_replace(c.cast("string"), r"\.0E", "E"), "E", "e")
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(plain)


def safe_name(c: Column, limit: int = 120, fallback: str = "file", blanks: str | None = None) -> Column:
    """File name without reserved characters, cut to ``limit``; ``blanks`` replaces runs of white space if given."""
    out = F.regexp_replace(c, r'[\\/:*?"<>|]+', "_")
    if blanks is not None:
        out = F.regexp_replace(out, f"{WS}+", blanks)
    out = js_trim(F.substring(out, 1, limit))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(fallback))


def canonical_download_name(c: Column) -> Column:
    """``x-12.pdf`` → ``x.pdf``: collision suffixes of one to three digits only."""
    return F.regexp_replace(c, r"^(.*)-\d{1,3}(\.[^./]+)$", "$1$2")


def extension(c: Column) -> Column:
    """Lower-case extension with its dot, '' if there is none."""
    return F.lower(F.regexp_extract(c, r"(\.[^./\\]*)$", 1))


def strip_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, r"^---\r?\n[\s\S]*?\r?\n---\r?\n*", "")


def strip_fences(c: Column) -> Column:
    """Only texts that hold a fence meet the patterns."""
    opened = F.regexp_replace(c, rf"(?i)^{WS}*```(?:[a-z]+)?{WS}*", "")
    return js_trim(F.when(F.contains(c, F.lit("```")), F.regexp_replace(opened, rf"{WS}*```{WS}*$", "")).otherwise(c))


def _markdown_blocks(c: Column) -> Column:
    """Drop the front matter, fenced code and heading marks."""
    out = F.regexp_replace(c, r"\r\n", "\n")
    out = F.regexp_replace(out, r"(?m)\A---[\s\S]*?^---\s*", "")
    out = F.regexp_replace(out, r"```[\s\S]*?```", "\n")
    return F.regexp_replace(out, r"(?m)^#{1,6}\s+", "")


def _markdown_inline(c: Column) -> Column:
    """Drop single emphasis and code marks; list marks become bullets."""
    out = F.regexp_replace(c, r"\*([^*\n]+)\*", "$1")
    out = F.regexp_replace(out, r"`([^`]+)`", "$1")
    out = F.regexp_replace(out, r"(?m)^\s*[-*+]\s+", "• ")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), f"{WS}+$", "")


def markdown_to_plain(c: Column) -> Column:
    return _markdown_inline(F.regexp_replace(_markdown_blocks(c), r"\*\*([^*]+)\*\*", "$1"))


def markdown_to_chat(c: Column) -> Column:
    """Drop marks a chat client would show; emphasis nests at most six deep."""
    out = F.regexp_replace(F.regexp_replace(c, r"\r\n", "\n"), r"(?m)^#{1,6}\s+", "")
    for _ in range(6):
        for mark in (r"\*\*([^*]+)\*\*", r"__([^_]+)__", r"`([^`]+)`"):
            out = F.regexp_replace(out, mark, "$1")
    return F.regexp_replace(out, r"(^|[\s>\"'(,:])_([^_\n]+)_(?=[\s)<\"',.:!?]|$)", "$1$2")


# Private-use characters that stand for the two ends of a bold span while offsets are being counted.
_OPEN, _CLOSE = "\ue000", "\ue001"


def bold_spans(c: Column) -> Column:
    """Struct of the text without bold marks and the [start, end) offsets of what ``**…**`` enclosed."""
    return _spans(F.regexp_replace(c, r"\*\*([^*]+)\*\*", f"{_OPEN}$1{_CLOSE}"))


def _spans(marked: Column) -> Column:
    parts = F.split(marked, _OPEN)
    spans = F.array().cast("array<struct<start:int,end:int>>")
    seed = F.struct(F.element_at(parts, 1).alias("plain"), spans.alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        start = F.length(acc["plain"])
        end = start + F.length(F.substring_index(part, _CLOSE, 1))
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(
            F.concat(acc["plain"], F.replace(part, F.lit(_CLOSE), F.lit(""))).alias("plain"),
            F.concat(acc["spans"], F.array(span)).alias("spans"),
        )

    return F.aggregate(F.slice(parts, 2, 1_000_000_000), seed, step)


def indent_paragraphs(c: Column) -> Column:
    """A tab before every paragraph except numbered heads, (n) items, bullets and those indented already."""
    letter = "[А-ЯЁA-Zа-яё]"
    kept = rf"^(?:\t| {{4,}}|[{_OPEN}]?(?:\d+\.{WS}+{letter}|\d+\.\d+{WS}+{letter}|\(\d+\){WS}|[•\-—]{WS}))"
    blocks = F.filter(F.transform(F.split(c, r"\n\n+"), js_trim), lambda p: p != "")
    return F.array_join(F.transform(blocks, lambda p: F.when(p.rlike(kept), p).otherwise(F.concat(F.lit("\t"), p))), "\n\n")


def document_body(c: Column) -> Column:
    """Markdown draft → plain indented text with its bold spans."""
    marked = F.regexp_replace(_markdown_blocks(c), r"\*\*([^*]+)\*\*", f"{_OPEN}$1{_CLOSE}")
    return _spans(indent_paragraphs(_markdown_inline(marked)))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def clean_message(c: Column, nfc: bool = True) -> Column:
    """Strip zero-width characters, compose (NFC), trim.

    Composition exists only in Python, and only texts with characters from U+0300 on can need it: the others are sent as
    NULL.  ``nfc=False`` keeps text known to be composed in the JVM.
    """
    out = F.regexp_replace(c, r"[\u200B-\u200D\uFEFF]", "")
    open_ = out.rlike(r"[^\x{0}-\x{2FF}]")
    return js_trim(F.when(open_, _nfc(F.when(open_, out))).otherwise(out) if nfc else out)


def strip_mentions(c: Column) -> Column:
    return collapse_ws(F.regexp_replace(c, r"@[A-Za-z0-9_]+", " "))


def shorten_error(c: Column, limit: int = 380) -> Column:
    """Struct of an error's kind, its first URL and a bounded one-line text."""
    flat = collapse_ws(c)
    quota = matches(flat, r"storagequotaexceeded|do not have storage quota|quota")
    url = F.nullif(F.regexp_extract(flat, r"^(https?://[^\s]+?):?(?:\s|$)", 1), F.lit(""))
    return F.struct(
        F.when(quota, "quota").otherwise("other").alias("kind"),
        url.alias("url"),
        truncate_marked(flat, limit, "…").alias("text"),
    )



def header_multiline(c: Column) -> Column:
    """Put the country of a customer's address on its own line."""
    country = rf"(Республика{WS}+Беларусь)"
    out = F.regexp_replace(js_trim(c), rf"(?iu),{WS}*{country}", "\n$1")
    out = F.regexp_replace(out, rf"(?iu)([«»\".!?]){WS}+{country}", "$1\n$2")
    return js_trim(F.regexp_replace(out, r"\n{3,}", "\n"))


def normalize_tsv(c: Column) -> Column:
    """Per line and tab cell: collapse blanks and trim, keep the tabs; more than one blank line becomes one."""
    unix = F.regexp_replace(c, r"\r\n?", "\n")
    lines = F.transform(
        F.split(unix, "\n"),
        lambda line: F.array_join(
            F.transform(F.split(line, "\t"), lambda cell: js_trim(F.regexp_replace(cell, r"[ \u00A0\f\x0B]+", " "))), "\t"
        ),
    )
    return js_trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def non_blank(c: Column) -> Column:
    return F.length(js_trim(c)) > 0


def chunk_limits(max_chars: int | None = None, overlap: int | None = None) -> tuple[int, int]:
    """Effective chunk size (floor 500) and overlap (12 % unless given, at most 15 %)."""
    size = max(500, CHUNK_CHARS if max_chars is None else max_chars)
    wanted = size * 12 // 100 if overlap is None else max(0, overlap)
    return size, min(size * 15 // 100, wanted)


def chunk_pieces(c: Column, max_chars: int | None = None, overlap: int | None = None) -> Column:
    """Text → array of chunks.

    Paragraphs are packed greedily up to the limit.  A longer paragraph stands alone and is cut with an overlap;
    the look-ahead cuts it in one linear pass, where repeated ``substring`` would rescan it for every piece.
    """
    size, lap = chunk_limits(max_chars, overlap)
    step = size - lap
    none = F.array().cast("array<string>")

    def cut(p: Column) -> Column:
        pieces = F.regexp_extract_all(p, F.lit(rf"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1))
        count = F.ceil((F.length(p) - size) / F.lit(step)).cast("int") + 1
        return F.filter(F.transform(F.slice(pieces, F.lit(1), count), js_trim), lambda x: x != "")

    def flushed(acc: Column) -> Column:
        return F.when(acc["buf"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buf"])))

    def pack(acc: Column, p: Column) -> Column:
        joined = F.when(acc["buf"] == "", p).otherwise(F.concat(acc["buf"], F.lit("\n\n"), p))
        long = F.length(p) > size
        fits = F.length(joined) <= size
        return F.struct(
            F.when(long, F.lit("")).when(fits, joined).otherwise(p).alias("buf"),
            F.when(long, F.concat(flushed(acc), cut(p))).when(fits, acc["out"]).otherwise(flushed(acc)).alias("out"),
        )

    def packed(paragraphs: Column) -> Column:
        seed = F.struct(F.lit("").alias("buf"), none.alias("out"))
        return F.aggregate(paragraphs, seed, pack, flushed)

    def pieces_of(text: Column) -> Column:
        # Most texts hold one paragraph, which needs no fold.
        single = F.when(text == "", none).when(F.length(text) > size, cut(text)).otherwise(F.array(text))
        paragraphs = F.filter(F.transform(F.split(text, r"\n\n+"), js_trim), lambda p: p != "")
        return F.when(text.contains("\n\n"), let(paragraphs, packed)).otherwise(single)

    return let(js_trim(F.replace(c, F.lit("\r\n"), F.lit("\n"))), pieces_of)


# Script ranges counted when the quality of a text layer is judged.
CYRILLIC = r"\u0400-\u04FF"
LATIN = "A-Za-z"
CJK = r"\u3040-\uFFE6&&[\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7AF\uFF00-\uFFE6]"


def class_count(c: Column, chars: str) -> Column:
    """How many characters of a class a text holds, without building the list of matches."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{chars}]+", ""))


def script_counts(c: Column) -> Column:
    return F.struct(
        class_count(c, CYRILLIC).alias("cyrillic"),
        class_count(c, LATIN).alias("latin"),
        class_count(c, CJK).alias("cjk"),
        class_count(c, r"\uFFFD").alias("replacement"),
    )



