"""Text operators against brute force on small tables with nulls, ties, repeats, long and odd texts."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

from docsluice.llm import bpe, license_scan, minhash, packing, quality, suffix_dedup, token_counts
from docsluice.llm.queries import tokenizer_file
from tests.llm.conftest import by_id

WORD_FILE = tokenizer_file("word_bpe_49k.json")
ODD = [None, "", " \n\t", "a", "The café, The CAFÉ!! <|endoftext|>x 3.14 don't", "Σίσυφος İstanbul 日本語 🙂👍🏽 \x1c\x85\u200b", "x" * 70_000, "word " * 3000]


def odd_rows():
    return [(10 + i, t) for i, t in enumerate(ODD)] + [(None, "no id here")]


def library():
    t = Tokenizer.from_file(WORD_FILE)
    return t


def test_bpe_is_the_librarys(frame):
    rows = odd_rows() + [(10, None), (14, ODD[4])]
    got = bpe.digest_documents(frame(rows), WORD_FILE).collect()
    assert len(got) == len(rows)
    lib = library()
    for row in got:
        text = dict(odd_rows())[row["doc_id"]] or ""
        e = lib.encode(text, add_special_tokens=False)
        assert row["n_tokens"] == len(e.ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_prefix_tokens_on_random_text():
    coder, lib, rng = bpe.vocabulary(WORD_FILE), library(), random.Random(3)
    letters = "aabcdeinorst  '.,!12ÉéßΣσςİı日本🙂́\x1c\x85\n<|endoftext|>"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert bpe.encode_text(text, coder).tolist() == lib.encode(text, add_special_tokens=False).ids, text
    word = "".join(rng.choice("abcdefghij") for _ in range(400))
    assert coder.encode_word(word) == coder.merge(coder.symbols(word + "</w>"))


def test_memo_is_bounded():
    memo = bpe.Memo(len, limit=10)
    for i in range(100):
        assert memo["k" * (i % 30)] == i % 30
        assert len(memo) <= 10 and len(memo.old) <= 10


def test_bpe_arrays_and_empty_table(frame):
    out = by_id(bpe.encode_documents(frame([(1, "Hello world")]), WORD_FILE))
    assert out[1]["ids"] == library().encode("Hello world", add_special_tokens=False).ids
    assert bpe.digest_documents(frame([]), WORD_FILE).count() == 0


def test_token_counts_share_prefixes(frame):
    model = token_counts.unigram(tokenizer_file("piece_bpe_32k.model"))

    def plain(word):
        best = [(0.0, 0)]
        for stop in range(1, len(word) + 1):
            size = len(word[stop - 1].encode())
            options = [(best[stop - 1][0] + size * model.byte_score, best[stop - 1][1] - size)]
            options += [(best[a][0] + model.scores[word[a:stop]], best[a][1] - 1) for a in range(stop) if word[a:stop] in model.scores]
            best.append(max(options))
        return -best[-1][1]

    rows = odd_rows()[:-3] + [(90, "the then theory thesis thin thing"), (None, "no id")]
    got = token_counts.count_tokens(frame(rows), tokenizer_file("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows)
    for row in got:
        words = (dict(rows)[row["doc_id"]] or "").split()
        assert (row["n_words"], row["n_tokens"]) == (len(words), sum(plain("▁" + w) for w in words))


def test_packing_places_every_piece(frame):
    rng = random.Random(1)
    rows = odd_rows() + [(100 + i, " ".join(rng.choice(["aa", "bb", "cc!"]) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(10, None)]
    size = 64
    got = packing.pack(frame(rows), WORD_FILE, size=size, with_ids=True).collect()
    lib, seen = library(), Counter((r["doc_id"], r["piece"]) for r in got)
    for doc_id, text in dict(rows).items():
        ids = lib.encode(text or "", add_special_tokens=False).ids + [1]
        times = sum(d == doc_id for d, _ in rows)
        for piece, at in enumerate(range(0, len(ids), size)):
            assert seen.pop((doc_id, piece)) == times
            row = next(r for r in got if (r["doc_id"], r["piece"]) == (doc_id, piece))
            cut = ids[at : at + size]
            assert (row["start"], row["length"], row["ids"]) == (at, len(cut), cut)
            assert row["ids_crc32"] == zlib.crc32(np.array(cut, "<u4").tobytes())
    assert not seen
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    least = -(-sum(r["length"] for r in got) // size)
    assert len(by_sequence) <= least * 1.05 + 1
    assert packing.pack(frame([]), WORD_FILE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 30, 5000])
def test_packing_plan_is_close_to_the_bound(n):
    lengths = np.minimum(4096, np.random.default_rng(n).lognormal(7, 1, n).astype(int) + 1)
    runs = packing.plan(Counter(lengths.tolist()))
    placed = Counter()
    for length, first, count, _, _ in runs:
        assert first == placed[length]
        placed[length] += count
    assert placed == Counter(lengths.tolist())
    assert max((r[3] + r[2] for r in runs), default=0) <= -(-int(lengths.sum()) // 4096) * 1.01 + 1


def test_packing_one_length_for_all():
    runs = packing.plan({1500: 1001})
    assert max(r[3] + r[2] for r in runs) == 501


def brute_repeats(rows, size):
    seen, out = set(), {}
    for doc_id, text in sorted({r for r in rows if r[0] is not None}):
        body = (text or "").encode()
        covered = bytearray(len(body))
        for at in range(len(body) - size + 1):
            window = body[at : at + size]
            if window in seen:
                covered[at : at + size] = b"\1" * size
            seen.add(window)
        kept = bytes(b for b, c in zip(body, covered) if not c)
        spans = sum(c and (i == 0 or not covered[i - 1]) for i, c in enumerate(covered))
        out[doc_id] = (len(body), len(body) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("size", [60, 100])
def test_suffix_dedup(frame, size):
    rng = random.Random(size)
    base = ["".join(rng.choice("abcd é") for _ in range(rng.randint(0, 300))) for _ in range(8)]
    rows = [(i * 3 - 20, "".join(rng.choice(base)[rng.randint(0, 50) :][: rng.randint(0, 200)] for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "a" * 400), (503, "a" * 90), (504, base[0] * 9), (504, base[0] * 9), (None, base[0] * 9)]
    got = suffix_dedup.digest(frame(rows, 5), size).collect()
    want = brute_repeats(rows, size)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]


def test_suffix_dedup_long_texts_and_pieces(frame, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 700)
    rng = random.Random(2)
    body = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    raw = np.frombuffer(body.encode(), np.uint8)
    one = list(suffix_dedup.anchors(raw, np.array([0, len(raw)]), 100, 36))
    monkeypatch.undo()
    whole = list(suffix_dedup.anchors(raw, np.array([0, len(raw)]), 100, 36))
    assert len(one) > 3 and len(whole) == 1
    pairs = {(s, a) for x in one for s, a in zip(x["w_start"].tolist(), x["w_anchor"].tolist())}
    assert pairs == set(zip(whole[0]["w_start"].tolist(), whole[0]["w_anchor"].tolist()))
    contexts = {(a, c) for x in one for a, c in zip(x["at"].tolist(), x["context"].tolist())}
    assert contexts == set(zip(whole[0]["at"].tolist(), whole[0]["context"].tolist()))


def test_remove_repeats_keeps_columns(frame):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghijk é") for _ in range(400))
    docs = frame([(1, text), (2, "start " + text + " end"), (3, None), (None, text)])
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["text"] == text and rows[None]["text"] == text and rows[3]["text"] is None
    assert rows[2]["text"] == "start  end" and rows[2]["n_chars"] == 10
    assert suffix_dedup.remove_repeats(frame([])).count() == 0


def brute_groups(rows, width, percent=80):
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        if doc_id is not None:
            sets[doc_id] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return {i: (len(s), group[i], group[i] == i) for i, s in sets.items()}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(frame, width):
    rng = random.Random(width)
    words = [f"w{i}" for i in range(50)]
    rows, base = [], [[rng.choice(words) for _ in range(n)] for n in (3, 6, 7, 12, 30, 60, 90)]
    for i in range(140):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(text))
            if rng.random() < 0.5:
                text[at] = rng.choice(words)
            elif len(text) > 1:
                del text[at]
        rows.append((i * 2 - 9, rng.choice([" ", "\n", "\t "]).join(text).upper() if i % 3 else " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "w1"), (1004, "W1 "), (1005, "é É"), (1006, "é É"), (1003, "w1"), (None, "w1")]
    got = minhash.near_duplicates(frame(rows), width).collect()
    want = brute_groups(rows, width)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]


def test_hot_group_of_near_copies(frame):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(1200):
        text = list(base)
        text[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(text)))
    got = minhash.near_duplicates(frame(rows, 7), 2).collect()
    assert {r["component_id"] for r in got} == {0}
    kept = minhash.keep_first(frame(rows, 7))
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_pairs_in_texts_of_frequent_lines(frame):
    rng = random.Random(5)
    pool = [[f"l{i}w{j}" for j in range(12)] for i in range(60)]
    rows = []
    for i in range(600):
        rows.append((i, [w for line in rng.sample(pool, 20) for w in line]))
    for i in range(100):  # a copy of some text with another line in it
        text = list(rows[rng.randrange(600)][1])
        at = 12 * rng.randrange(20)
        rows.append((600 + i, text[:at] + rng.choice(pool) + text[at + 12 :]))
    ids = rng.sample(range(10_000), 700)
    rows = [(ids[i], " ".join(words)) for i, words in rows]
    want = brute_groups(rows, 2)
    assert sum(not kept for _, _, kept in want.values()) > 50
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(rows), 2).collect()} == {i: g for i, (_, g, _) in want.items()}


def test_sets_do_not_depend_on_pieces(monkeypatch):
    text = ("alpha  Beta\tgamma " * 50 + "é" * 40).encode()
    raw = np.frombuffer(text, np.uint8)
    whole = minhash.shingle_sets(raw, np.array([0, len(raw)]), 2)
    monkeypatch.setattr(minhash, "PIECE_BYTES", 64)
    monkeypatch.setattr(minhash, "groups_of_rows", lambda bounds: iter([(0, 1)]))
    cut = minhash.shingle_sets(raw, np.array([0, len(raw)]), 2)
    assert (whole[0] == cut[0]).all()


def test_union_estimate():
    a = np.array([[1, 2, 3, 4]], np.uint64)
    assert minhash.union_estimate(a, a)[0] == 1
    assert minhash.union_estimate(a, np.array([[5, 6, 7, 8]], np.uint64))[0] == 0
    assert minhash.union_estimate(a, np.array([[1, 2, 3, 9]], np.uint64))[0] == 0.75


def test_license_phrases_and_errors(frame):
    rows = odd_rows() + [
        (1, "CC BY-NC. General-Public license; all rights RESERVED! cc by cc by"),
        (2, "ccby accc by cc bye"),
        (3, "Lisensed under the Apache Licence, Version 2.0"),
        (4, "released under the rnit license"),
        (5, "Licensed under completely different terms of the apache tribe"),
    ]
    got = by_id(license_scan.scan_documents(frame(rows)))
    word = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for doc_id, text in rows:
        body = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        words = [w.decode() for w in word.findall(body)]
        places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = got[doc_id]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[3]["labels"] == "apache-2.0" and 0 < got[3]["score"] < 1 and got[3]["spans"][0]["first"] == 0
    assert got[4]["labels"] == "mit" and got[5]["labels"] == "" and got[2]["n_base"] == 0
    assert license_scan.scan_documents(frame([])).count() == 0


def test_seeds_find_every_notice_within_its_errors():
    scan = license_scan.scanner(tuple(license_scan.PHRASES.items()), tuple(license_scan.NOTICES.items()))
    rng = random.Random(4)
    for notice, label in license_scan.NOTICES.items():
        errors = min(license_scan.MAX_ERRORS, len(notice) // license_scan.LETTERS_PER_ERROR)
        for _ in range(20):
            text = list(notice)
            for _ in range(errors):
                at = rng.choice([i for i in range(1, len(text) - 1) if " " not in text[i - 1 : i + 2]])
                kind = rng.randrange(3)
                text[at : at + 1] = ["q"] if kind == 0 else ([] if kind == 1 else [text[at], "q"])
            body = license_scan.plain("zz " + "".join(text) + " zz")
            assert label in {x[2] for x in scan.fuzzy(body)}, body


def test_quality_network_learns_and_scores_every_text(frame, spark):
    rng = random.Random(6)
    good = [" ".join(rng.choice(["stone", "river", "light", "and", "the"]) for _ in range(80)) for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "NOW!!", "%%%"]) for _ in range(80)) for _ in range(150)]
    rows = list(enumerate(x for pair in zip(good, bad) for x in pair)) + [(900, None), (901, ""), (None, good[0]), (0, good[0])]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(0, 1, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.judge(frame(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
            if r["doc_id"] < 300:
                assert r["predicted"] == 1 - r["doc_id"] % 2
    kept = quality.keep_good(frame(rows), labels)
    assert kept.columns == frame(rows).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(range(0, 300, 2)) <= set(ids) and not set(range(1, 300, 2)) & set(ids)


def test_quality_reads_long_texts_to_the_end(monkeypatch):
    net = quality.fit([b"good words here " * 40] * 30 + [b"BAD!! $$$ " * 60] * 30, [1] * 30 + [0] * 30)
    text = np.frombuffer(b"good words here " * 3000 + b"BAD!! $$$ " * 300, np.uint8)
    whole = quality.score_text(net, text)
    monkeypatch.setattr(quality, "BLOCK", 2000)
    assert abs(quality.score_text(net, text) - whole) < 1e-5
    assert whole < quality.score_text(net, text[:48000])


def test_quality_without_labels(frame, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.judge(frame([(1, "x"), (2, None)]), labels).collect()} == {1.0}
    assert quality.judge(frame([]), labels).count() == 0
