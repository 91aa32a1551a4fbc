from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsluice.functions import money
from docsluice.functions import text as tx
from docsluice.functions import urls
from docsluice.functions.patterns import matches


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("r")).first()["r"]


def packed(text, size, lap):
    """Chunks by hand: the brute force beside the expression."""
    out, buf = [], ""
    paragraphs = [p.strip() for p in __import__("re").split(r"\n\n+", text.replace("\r\n", "\n").strip()) if p.strip()]
    for p in paragraphs:
        if len(p) > size:
            if buf:
                out.append(buf)
            buf, at = "", 0
            while True:
                end = min(at + size, len(p))
                if p[at:end].strip():
                    out.append(p[at:end].strip())
                if end >= len(p):
                    break
                at = end - lap
        elif buf and len(buf) + 2 + len(p) > size:
            out.append(buf)
            buf = p
        else:
            buf = f"{buf}\n\n{p}" if buf else p
    return out + ([buf] if buf else [])


paragraph = st.text(alphabet="ab cд\n", min_size=0, max_size=900)


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.lists(paragraph, max_size=6).map("\n\n".join), min_size=1, max_size=8))
def test_chunks_equal_brute_force(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    got = rows.select("i", tx.chunk_pieces(F.col("c"), 500, 70).alias("p")).collect()
    for row in got:
        assert row["p"] == packed(texts[row["i"]], 500, 70)


def test_chunk_limits():
    assert tx.chunk_limits() == (3500, 420)
    assert tx.chunk_limits(100, 400) == (500, 75)


def test_white_space_of_every_kind(spark):
    assert one(spark, " ﻿ a  b 　", tx.collapse_ws) == "a b"
    assert one(spark, " «a» ’b’", tx.normalize_evidence) == "\"a\" 'b'"


def test_letter_aware_dialects(spark):
    assert one(spark, "ПРОЦЕДУРА  улучшения", lambda c: matches(c, r"процедур\w*\s+улучшен"))
    assert not one(spark, "процедура улучшения", lambda c: matches(c, r"процедур\w*\s+улучшен", "ascii"))
    assert one(spark, "снижение.", lambda c: matches(c, r"снижен(?:ие|ия)\b"))


def test_bold_spans_and_body(spark):
    r = one(spark, "a **b c** d **e**", tx.bold_spans)
    assert r["plain"] == "a b c d e" and [(s["start"], s["end"]) for s in r["spans"]] == [(2, 5), (8, 9)]
    body = one(spark, "# 1. Тема\n\nтекст **жирный**\n\n(1) пункт", tx.document_body)
    assert body["plain"] == "1. Тема\n\n\tтекст жирный\n\n(1) пункт"
    assert body["plain"][body["spans"][0]["start"] : body["spans"][0]["end"]] == "жирный"


def test_markdown_for_chat(spark):
    assert one(spark, "## T\n**a __b__** `c` _d_", tx.markdown_to_chat) == "T\na b c d"


def test_safe_names(spark):
    assert one(spark, 'a/b:c?.pdf', tx.safe_name) == "a_b_c_.pdf"
    assert one(spark, "  ", tx.safe_name) == "file"
    assert one(spark, "x-12.pdf", tx.canonical_download_name) == "x.pdf"
    assert one(spark, "x-2024.pdf", tx.canonical_download_name) == "x-2024.pdf"


def test_money(spark):
    assert one(spark, "1 200,50 BYN", money.parse_money) == 1200.5
    assert one(spark, "2,5 млн. руб.", money.parse_money) == 2_500_000
    assert one(spark, "нет", money.parse_money) is None
    assert one(spark, "лот: USD 1 500.25", money.line_amount) == 1500.25
    words = {0: money.ZERO, 1: "один белорусский рубль", 2_000: "две тысячи белорусских рублей", 21_112: "двадцать одна тысяча сто двенадцать белорусских рублей"}
    for n, said in words.items():
        assert one(spark, n, money.amount_words, "bigint") == said


def test_urls(spark):
    base = F.lit("https://A.example.com/x/y.html?q=1#z")
    cases = {"../b c.pdf": "https://a.example.com/b%20c.pdf", "//h/ж": "https://h/%D0%B6", "mailto:x@y": None, "": "https://a.example.com/x/y.html?q=1"}
    for href, want in cases.items():
        assert one(spark, href, lambda c: urls.resolve_url(base, c)) == want
    ids = one(spark, "https://www.p.by/view/12 p.by/view/13, xp.by/view/14", lambda c: urls.view_ids(c, "p.by/view/"))
    assert ids == ["12", "13"]
