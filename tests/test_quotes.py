"""Quotes located in cells against plain search in the whole normalised text."""

import random
import re

import pytest

from docsluice.operators import grounding, quotes

WS = r"[\t\n\x0b\f\r \xa0  -     　﻿]+"


def normal(text):
    return re.sub(WS, " ", text.translate(str.maketrans("«»„“”’′", "\"\"\"\"\"''"))).strip(" ")


def words(rng, n, letters="abde é日🙂\n«"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.fixture
def small(monkeypatch):
    """Chunks, cells, spans and blocks so small that every one of them is crossed."""
    for name, value in {"CHUNK_CHARS": 16, "CELL_CHARS": 50, "SPAN_CELLS": 2, "BLOCK_CHARS": 400, "MANY": 3}.items():
        monkeypatch.setattr(quotes, name, value)


def units(spark, rows):
    schema = "tender_id string, quotes array<struct<slot:int,quote:string>>, start int, unit string"
    return spark.createDataFrame([(t, [(0, q)], 1, "x") for t, q in rows], schema)


def located(spark, rows, corpora):
    got = quotes.locate(units(spark, rows), corpora, 1)
    return {(r["tender_id"], bytes(r["unit"])): r["at_0"] for r in got.collect()}


def check(spark, texts, rows, corpora):
    got = located(spark, rows, corpora)
    ids = {(r["tender_id"], r["q"]): bytes(r["unit"]) for r in units(spark, rows).selectExpr("tender_id", "quotes[0].quote q", "quotes").withColumn("unit", quotes.unit_id(quotes.F.col("quotes"))).collect()}
    for tender, quote in rows:
        at = normal(texts.get(tender, "")).find(quote) if quote and len(quote) >= quotes.GRAM else -1
        assert got.get((tender, ids[tender, quote])) == (at if at >= 0 else None), (tender, quote)


def quoted(rng, text, n):
    text = normal(text)
    out = []
    for _ in range(n):
        size = rng.choice([5, 13, 14, 15, 30, 120])
        at = rng.randrange(max(1, len(text) - size))
        quote = text[at : at + size].strip(" ")
        out.append(quote if rng.random() < 0.7 else quote[:-1] + "#")
    return out


def test_hot_tender_and_crossed_cells(spark, small):
    rng = random.Random(3)
    texts = {"hot": words(rng, 3000), "b": words(rng, 400), "c": " \n ", "one": "a" * 300}
    rows = [("hot", q) for q in quoted(rng, texts["hot"], 300)]
    rows += [("b", q) for q in quoted(rng, texts["b"], 30)] + [("one", "a" * 20), ("one", "a" * 20 + "b"), ("c", "x" * 20), ("none", "y" * 20), ("hot", None), ("b", "")]
    rows = list(dict.fromkeys(rows))
    check(spark, texts, rows, spark.createDataFrame([*texts.items(), ("null", None)], "tender_id string, corpus string"))


def test_numbered_parts_are_one_text(spark, small):
    rng = random.Random(5)
    texts = {"t": words(rng, 1500, "ab  \n c"), "u": "   lead " + words(rng, 100) + "   "}
    parts = []
    for tender, text in texts.items():
        at = part = 0
        while at < len(text):
            size = rng.choice([1, 2, 7, 90])
            parts.append((tender, part, text[at : at + size]))
            at, part = at + size, part + 1
    corpora = spark.createDataFrame(parts, "tender_id string, part int, corpus string").repartition(5)
    rows = list(dict.fromkeys((t, q) for t, text in texts.items() for q in quoted(rng, text, 80)))
    check(spark, texts, rows, corpora)
    whole = {t: "" for t in texts}
    for r in sorted(quotes.normalized_chunks(corpora).collect(), key=lambda r: (r["tender_id"], r["start"])):
        assert r["start"] == len(whole[r["tender_id"]])
        whole[r["tender_id"]] += r["chunk"]
    assert {t: w.strip(" ") for t, w in whole.items()} == {t: normal(x) for t, x in texts.items()}


def test_index_finds_what_find_finds():
    rng = random.Random(1)
    for _ in range(60):
        text = words(rng, rng.choice([10, 40, 400]), rng.choice(["ab", "abc d", "aé🙂"]))
        asked = [q for q in {*quoted(rng, text, 20), "a" * 14, "ab" * 30} if len(q) >= quotes.GRAM]
        if asked:
            got = dict(quotes.QuoteIndex(asked).find(text))
            assert got == {k: text.find(q) for k, q in enumerate(asked) if q in text}


def test_claims_of_a_hot_tender(spark, small):
    rng = random.Random(8)
    lines = [words(rng, rng.randint(5, 60), "abcdefgh ") for _ in range(400)]
    corpora = spark.createDataFrame([("hot", "\n".join(lines)), ("b", "nothing of the kind stands here")], "tender_id string, corpus string")
    claims = [("hot" if rng.random() < 0.9 else "b", str(i), "manager", "n", "b", rng.choice(lines), lines[i] if i % 3 else lines[i] + "!") for i in range(400)]
    schema = "tender_id string, claim_id string, list string, name string, basis string, criteria string, evidence string"
    got = {r["claim_id"]: r for r in grounding.ground_claims(spark.createDataFrame(claims, schema), corpora).collect()}
    assert len(got) == len(claims)
    text = {"hot": normal("\n".join(lines)), "b": "nothing of the kind stands here"}
    for tender, i, _, _, _, criteria, evidence in claims:
        for name, quote in (("first_at", normal(evidence)), ("criteria_at", normal(criteria))):
            at = text[tender].find(quote) if len(quote) >= 14 else -1
            assert got[i][name] == (at if at >= 0 else None)
        assert got[i]["grounded"] == (got[i]["first_at"] is not None)


def test_nothing_to_look_up(spark):
    none = spark.createDataFrame([], "tender_id string, corpus string")
    assert located(spark, [("a", "x" * 20)], none) == {}
    assert located(spark, [("a", "short"), ("a", None)], spark.createDataFrame([("a", "short text")], "tender_id string, corpus string")) == {}
