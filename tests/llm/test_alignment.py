"""Cross-tokenizer alignment against a brute-force version that walks over bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from docsluice.llm import alignment
from docsluice.llm.queries import tokenizer_file

BYTES, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "  two  spaces \n\n", "plain words in a row", "plain words in a row", "mark ▁ inside", "\x00\x01\x7f", "Σίσυφος İstanbul 日本語 🙂👍🏽 \x85​",
       "<|endoftext|> </s> <s> <0x41>", "don't we'll 3.14 ½", "x" * 3000, "word " * 3000]


class Brute:
    def __init__(self):
        self.a = Tokenizer.from_file(BYTES)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=PIECES)
        letters = alignment.byte_letters()
        self.letter = {c: b for b, c in enumerate(letters)}

    def spans(self, text):
        """Byte ranges and ids of both token sequences, or None."""
        out = []
        a = self.a.encode(" " + text, add_special_tokens=False)
        pieces = [self.b.id_to_piece(i) for i in self.b.encode(text)]
        spelled = [[bytes(self.letter[c] for c in t) for t in a.tokens],
                   [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]]
        for ids, parts in zip((a.ids, self.b.encode(text)), spelled):
            if b"".join(parts) != b" " + text.encode():
                return None
            at, seq = 0, []
            for i, p in zip(ids, parts):
                seq.append((at, at + len(p), i))
                at += len(p)
            out.append(seq)
        return out

    def docs(self, rows):
        held, all_links, facts = Counter(), [], []
        for _, text in rows:
            both = self.spans(text) if text else None
            if both is None:
                all_links.append([])
                facts.append((0, 0, 0, ""))
                continue
            a, b = both
            owner = {byte: y for x0, x1, y in b for byte in range(x0, x1)}
            span = {byte: x0 for x0, x1, _ in b for byte in range(x0, x1)}
            links = [(i, owner[s]) for x0, x1, i in a for s in sorted({max(span[byte], x0) for byte in range(x0, x1)})]
            cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
            text_groups, low = [], 0
            for c in cuts:
                text_groups.append("|".join(",".join(str(i) for s, e, i in seq if low <= s and e <= c) for seq in (a, b)))
                low = c
            held.update(set(links))
            all_links.append(links)
            facts.append((len(a), len(b), len(cuts), hashlib.sha256(";".join(text_groups).encode()).hexdigest()))
        top = defaultdict(int)
        for (i, _), n in held.items():
            top[i] = max(top[i], n)
        return [(f[0], f[1], f[2], len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), f[3]) for f, links in zip(facts, all_links)]


@pytest.fixture(scope="module")
def brute():
    return Brute()


def rows():
    rng = random.Random(2)
    words = ["".join(rng.choice("abdeinorst") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["é", "日本", "...", "\n", "  ", "'s", "12"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    return out + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (3, out[3][1])]


@pytest.mark.parametrize("block", [1 << 24, 200])
def test_digest(frame, brute, block):
    data = rows()
    got = alignment.digest(frame(data), BYTES, PIECES, block).collect()
    want = [(i, *r) for (i, _), r in zip(data, brute.docs(data))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r["doc_id"], *(r[n] for n in NAMES)) for r in got), key=key) == sorted(want, key=key)


def test_pair_counts_and_groups(frame, brute):
    data = rows()
    counts = {(r["a_id"], r["b_id"]): (r["count"], r["best"]) for r in alignment.pair_counts(frame(data), BYTES, PIECES, 500).collect()}
    whole = {(r["a_id"], r["b_id"]): (r["count"], r["best"]) for r in alignment.pair_counts(frame(data), BYTES, PIECES).collect()}
    assert counts == whole and counts
    by_doc = defaultdict(list)
    for r in alignment.groups(frame(data), BYTES, PIECES).collect():
        by_doc[r["doc_id"]].append(r)
    for i, text in data:
        found = sorted(by_doc.get(i, []), key=lambda r: r["group"])
        if text and i not in (None, 3) and brute.spans(text):
            assert [r["start"] for r in found] == [0, *[r["end"] for r in found[:-1]]] and found[-1]["end"] == len(text.encode()) + 1
            digest = hashlib.sha256(";".join(f"{','.join(map(str, r['a_ids']))}|{','.join(map(str, r['b_ids']))}" for r in found).encode()).hexdigest()
            assert digest == brute.docs([(i, text)])[0][6]
        elif i not in (None, 3):
            assert not found


def test_pieces_of_long_texts_encode_alike(brute):
    model = alignment.aligner(BYTES, PIECES)
    rng = random.Random(5)
    text = "".join(rng.choice("ab é日.,'\n \t 1½") for _ in range(20_000)) + " tail"
    parts = alignment.cut(text, 50)
    assert len(parts) > 100 and " ".join(parts) == text
    whole = brute.a.encode(" " + text, add_special_tokens=False).ids, brute.b.encode(text)
    assert [i for p in parts for i in model.a.encode(" " + p)] == whole[0]
    assert [i for ids in model.b.model.encode(parts) for i in ids] == whole[1]
    assert alignment.cut("a b", 5) == ["a b"] and alignment.cut("x" * 100, 5) == ["x" * 100]


def test_very_long_runs(brute):
    model = alignment.aligner(BYTES, PIECES)
    for text in (" " * 1_500_000, "y" * 200_000):
        assert len(model.a.encode(text)) == len(brute.a.encode(text, add_special_tokens=False).ids)


def test_pointer_jumping_on_a_long_chain():
    # Tokens of three bytes, set off by one: one component, thousands of steps long.
    a_end = np.array([*range(2, 9000, 3), 9000])
    b_end = np.arange(3, 9001, 3)
    assert set(alignment.last_tokens(a_end, b_end)) == {len(b_end) - 1}
    assert alignment.last_tokens(np.array([1, 2]), np.array([1, 2])).tolist() == [0, 1, 0, 1]


def test_packed_links_come_back():
    index, times = np.array([0, 3, 70_000, 5_000_000]), np.array([1, 300, 2, 70_000])
    back = alignment.unpack(alignment.pack(index, times))
    assert back[0].tolist() == index.tolist() and back[1].tolist() == times.tolist()
    assert alignment.unpack(alignment.pack(index[:0], times[:0]))[0].size == 0


def test_empty_table(frame):
    empty = frame([(1, "x")]).where("false")
    assert alignment.digest(empty, BYTES, PIECES).count() == 0
    assert alignment.groups(empty, BYTES, PIECES).count() == 0
    assert alignment.pair_counts(empty, BYTES, PIECES).count() == 0
