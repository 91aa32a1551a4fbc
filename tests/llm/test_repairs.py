"""Ties at the cut of a search, near repeats of a notice, long lists of sketches, long labelled texts, and the network's pass on its own."""

import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from docsluice.llm import ann, license_scan, minhash, quality
from tests.llm.test_texts import brute_groups


def test_ties_between_different_vectors_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(2)
    rows = [(0, [1.0, 0.0, 0.0])]
    for i in range(1, 301):  # all score 1 against the query
        a, b = rng.normal(size=2)
        rows.append((i, [1.0, float(a), float(b)]))
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 21)) and {r["score"] for r in got} == {1.0}


def test_best_rows_with_rounded_products():
    rng = np.random.default_rng(5)
    x = rng.choice([0.1, 0.2, 0.3, 0.7], size=(400, 16))
    q, ids = rng.choice([0.1, 0.3], size=(30, 16)), rng.permutation(10_000)[:400]
    row, hit, score = ann.best_rows(q, x, ids, 7, float(np.linalg.norm(x, axis=1).max()))
    exact = (q[:, None, :] * x[None, :, :]).sum(-1)
    for i in range(30):
        want = sorted(range(400), key=lambda j: (-exact[i, j], ids[j]))[:7]
        assert hit[row == i].tolist() == want and score[row == i].tolist() == exact[i, want].tolist()
    row, hit, _ = ann.best_rows(q, x[:3], ids[:3], 3, 10.0)
    assert np.bincount(row).tolist() == [3] * 30


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        row = out
    return row[-1]


def test_no_near_repeat_of_a_notice_is_lost():
    scan = license_scan.Scanner((("all rights reserved", "reserved"),), (("all rights reserved", "reserved"),))
    found = scan.scan("all rightx reserved all rights reserved")[7]
    assert [(f, last) for f, last, _, _ in found] == [(0, 2), (3, 5)]
    rng = random.Random(4)
    notice = "all rights reserved"
    for _ in range(200):
        parts = []
        for _ in range(rng.randint(1, 4)):
            word = list(notice)
            for _ in range(rng.choice([0, 0, 1, 1])):
                word[rng.randrange(len(word))] = rng.choice("xyz")
            parts.append("".join(word))
        body = " ".join(parts)
        spans = scan.fuzzy(body)
        assert len(spans) == len(parts)
        for start, stop, _, errors in spans:
            assert distance(body[start:stop], notice) == errors


def test_best_matches_leave_nothing_behind():
    pattern = regex.compile("(?b)(?:abcdef){e<=1}")
    body = "abxdef abcdef abcdxf--abcdef"
    found = sorted((m.start(), m.end()) for m in license_scan.best_matches(pattern, body, 0, len(body)))
    assert len(found) == 4 and all(b <= c for (_, b), (c, _) in zip(found, found[1:]))


def test_long_labelled_texts_train(spark):
    rng = random.Random(1)
    good = [" ".join("".join(rng.choice("aeiou") + rng.choice("lmnr") for _ in range(3)) for _ in range(13_000)) + "." for _ in range(30)]
    bad = ["".join(rng.choice("#$%&*0123456789") for _ in range(200)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert min(len(t) for t in good) > quality.SAMPLE_BYTES
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} == set(range(30))


def plain_score(net, raw):
    """Window by window, from the parameters and the bytes alone."""
    raw = raw + bytes(max(0, quality.WIDTH - len(raw)))
    starts = list(range(0, len(raw) - quality.WIDTH + 1, quality.STRIDE))
    if starts[-1] != len(raw) - quality.WIDTH:
        starts.append(len(raw) - quality.WIDTH)
    seen = quality.repeats(np.frombuffer(raw, np.uint8))
    responses = []
    for s in starts:
        x = [v for byte in raw[s : s + quality.WIDTH] for v in net.embed[byte]]
        x += [sum(float(seen[i]) for i in range(s, s + quality.WIDTH)) / quality.WIDTH, 1.0]
        responses.append([max(0.0, sum(a * b for a, b in zip(x, net.filters[:, f]))) for f in range(quality.FILTERS)])
    logits, at = [], 0
    while True:
        pooled = [max(r[f] for r in responses[at : at + quality.CHUNK]) for f in range(quality.FILTERS)]
        logits.append(sum(p * o for p, o in zip(pooled, net.out)) + net.bias)
        at += quality.HOP
        if at >= max(1, len(starts) - quality.CHUNK + quality.HOP):
            break
    return 1 / (1 + np.exp(-sum(logits) / len(logits)))


def test_the_networks_score_by_a_plain_pass():
    rng = np.random.default_rng(3)
    net = quality.Net(
        rng.normal(0, 0.3, (256, quality.EMBED)).astype(np.float32), rng.normal(0, 0.1, (quality.WIDTH * quality.EMBED + 2, quality.FILTERS)).astype(np.float32),
        rng.normal(0, 0.2, quality.FILTERS).astype(np.float32), 0.1,
    )
    for size in (0, 1, quality.WIDTH, 300, 2500):
        raw = bytes(rng.integers(97, 107, size).astype(np.uint8))
        assert abs(quality.score_text(net, np.frombuffer(raw, np.uint8)) - plain_score(net, raw)) < 1e-4


def frequent_lines(seed: int, texts: int, copies: int):
    rng = random.Random(seed)
    pool = [[f"l{i}w{j}" for j in range(12)] for i in range(60)]
    rows = [[w for line in rng.sample(pool, 20) for w in line] for _ in range(texts)]
    for _ in range(copies):
        text = list(rows[rng.randrange(texts)])
        at = 12 * rng.randrange(20)
        rows.append(text[:at] + rng.choice(pool) + text[at + 12 :])
    ids = rng.sample(range(10 * len(rows)), len(rows))
    return [(i, " ".join(words)) for i, words in zip(ids, rows)]


@pytest.mark.parametrize("wide", [50, 2000])
def test_long_lists_are_split_without_loss(frame, monkeypatch, wide):
    """Every list long: in several parts, in several blocks, and split level by level where that takes fewer comparisons."""
    rows = frequent_lines(3, 240, 60)
    rows += [(10_000 + i, f"u{i} " + rows[0][1]) for i in range(40)]
    want = {i: g for i, (_, g, _) in brute_groups(rows, 2).items()}
    for name, value in (("WIDE", wide), ("LIST_PART", 64), ("BLOCK", 16)):
        monkeypatch.setattr(minhash, name, value)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(rows), 2).collect()} == want


def test_a_frequent_line_makes_no_list(spark):
    """A line that all texts hold fills fewer than 7 of 20 retained values of most, and those texts are in no list."""
    rng = random.Random(8)
    line = " ".join(f"c{i}" for i in range(25))
    rows = [(i, " ".join(f"w{rng.randrange(10**7)}" for _ in range(150)) + " " + line) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = minhash.sketches(docs, 2).select(F.col("doc_id").alias("id"), "n", "kept", "brief")
    lists = minhash.first_lists(minhash.by_rarity(sets))
    assert lists.count() < 120
    assert minhash.least_shared(80) == 7 and minhash.least_shared(50) == 1


def test_near_duplicates_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).collect() == []
    assert minhash.keep_first(docs).collect() == []
