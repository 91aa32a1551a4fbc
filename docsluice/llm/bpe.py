"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has one last token in its BPE encoding.  An Aho-Corasick automaton over the vocabulary (the
suffix automaton of the matches) gives the tokens that end at each position; the one whose remaining prefix has a last
token it is compatible with is stored, and following the stored tokens back gives the exact ids.  Two tokens are
compatible if merging their joined letters yields those two again, which is decided by undoing merges along the seam.

Words never cross white space, so the ids of a white-space-bounded chunk are remembered per task in a bounded table and
most of a text is looked up.  Null texts are empty; empty texts have no tokens; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from docsluice.llm.common import texts

# The splitting pattern and the special tokens of the vocabulary file's own format.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
MEMO_CHUNKS = 300_000  # remembered chunks in each of a worker's two generations
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
# Letters that every Unicode version since 6 classes alike; other chunks are split by the library's own splitter.
_KNOWN = regex.compile(r"[\x00-\u0233\u0386-\u03ce\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")


class Memo(dict):
    """What a key leads to, computed on first sight.  Bounded: a full table becomes the old generation and the old one
    goes, so what is in use stays."""

    def __init__(self, make, limit: int = MEMO_CHUNKS):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str):
        value = self.look(key)
        if value is None:
            value = self.make(key)
            if len(key) <= 64:
                self.put(key, value)
        return value

    def look(self, key: str):
        """A remembered value or None; one of the old generation is kept."""
        value = self.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(kept))
    return [letters[b] for b in range(256)]


_WORDS = regex.compile(WORDS)
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9 \t\n\x0b\x0c\r]+")


def plain_words(piece: str) -> list[str] | None:
    """Normalised, lower-cased words of a text without special tokens; None if it has letters that need the library."""
    if piece.isascii():
        plain = piece.lower()
        return [plain] if plain.isalpha() else _ASCII_WORDS.findall(plain)
    if not _KNOWN.fullmatch(piece):
        return None
    plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
    return [plain] if _LATIN.fullmatch(plain) else _WORDS.findall(plain)


class WordBpe:
    """A vocabulary file of the tokenizers library: BPE with word ends over byte letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.ids.items(), *self.specials.items()]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {m: r for r, m in enumerate(merges)}
        self.parts: dict[str, tuple[str, str]] = {}  # the merge that makes a token
        self.made: dict[str, int] = {}
        for r, (a, b) in enumerate(merges):
            if a + b not in self.parts:
                self.parts[a + b], self.made[a + b] = (a, b), r
        self.letters = byte_letters()
        self.table = {b: c for b, c in enumerate(self.letters)}
        self.library = Tokenizer.from_file(path)
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in self.specials) + ")") if self.specials else None
        self.word_ids = Memo(self._ids_of_word, MEMO_CHUNKS // 2)
        self.pairs: dict[tuple[str, str], bool] = {}
        # Only tokens that the merges can build on their own take part.
        self.matches = ahocorasick.Automaton()
        for token in self.ids:
            if self.buildable(token):
                self.matches.add_word(token, token)
        self.matches.make_automaton()

    def symbols(self, text: str) -> list[str]:
        """Initial symbols of a token or word: letters, the last one with the word end if there is one."""
        if text.endswith(WORD_END) and len(text) > len(WORD_END):
            body = text[: -len(WORD_END)]
            return [*body[:-1], body[-1] + WORD_END]
        return list(text)

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: merge the pair of lowest rank, leftmost first, until none is left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min(((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:]))))
            if best[0] == 1 << 60:
                break
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def buildable(self, token: str) -> bool:
        if len(self.symbols(token)) == 1:
            return True
        if token not in self.parts:
            return False
        a, b = self.parts[token]
        return a in self.ids and b in self.ids

    def compatible(self, left: str, right: str) -> bool:
        """Whether the letters of two tokens, merged together, give those two tokens again."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._seam(left, right)
        return known

    def _seam(self, a: str, b: str) -> bool:
        """Undo the later of the two merges at the seam, again and again; a pair that merges sooner forbids the seam."""
        limit = 1 << 60
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < limit:
                return False
            made_a, made_b = self.made.get(a, -1), self.made.get(b, -1)
            if made_a > made_b:
                limit = made_a
                a = self.parts[a][1]
                r = self.rank.get((a, b))
                if r is not None and r < limit:
                    return False
            elif made_b >= 0:
                limit = made_b
                b = self.parts[b][0]
                r = self.rank.get((a, b))
                # On a tie of ranks the leftmost pair goes first.
                if r is not None and r <= limit:
                    return False
            else:
                return True

    def _ids_of_word(self, word: str) -> list[int]:
        if word in self.specials:
            return [self.specials[word]]
        return [self.ids[t] for t in self.encode_word(word) if t in self.ids]

    def encode_word(self, word: str) -> list[str]:
        """Tokens of one word of byte letters."""
        text, n = word + WORD_END, len(word)
        whole = self.ids.get(text)
        if whole is not None and n < 2:
            return [text]
        last: list[str | None] = [None] * (n + 1)
        ends: list[list[str]] = [[] for _ in range(n + 1)]
        for at, token in self.matches.iter(text):
            stop = at + 1
            if stop == len(text) and token.endswith(WORD_END) and len(token) > len(WORD_END):
                ends[n].append(token)
            elif stop < n:
                ends[stop].append(token)
        for stop in range(1, n + 1):
            for token in ends[stop]:  # longest first
                size = len(token) - (len(WORD_END) if stop == n else 0)
                before = stop - size
                if before == 0 or (last[before] is not None and self.compatible(last[before], token)):
                    last[stop] = token
                    break
        out, stop = [], n
        while stop > 0:
            token = last[stop]
            if token is None:  # a vocabulary that is not closed under its merges
                return self.merge(self.symbols(text))
            out.append(token)
            stop -= len(token) - (len(WORD_END) if stop == n else 0)
        return out[::-1]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a text without white space between words (white space is allowed and separates)."""
        return [i for word in self.words_of(chunk) for i in self.word_ids[word]]

    def words_of(self, chunk: str) -> list[str]:
        """Words and special tokens of a chunk; each is a key of ``word_ids``."""
        if "<|" not in chunk or not self.split:
            return self.split_words(chunk)
        words: list[str] = []
        for piece in self.split.split(chunk):
            words += [piece] if piece in self.specials else self.split_words(piece)
        return words

    def split_words(self, piece: str) -> list[str]:
        """Words of a text as byte letters: normalised, lower-cased, split by the pattern."""
        words = plain_words(piece)
        if words is not None:
            return [w if w.isalpha() and w.isascii() else w.encode("utf-8").decode("latin-1").translate(self.table) for w in words]
        plain = self.library.normalizer.normalize_str(piece)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=2)
def id_memo(path: str) -> Memo:
    """Chunk to the bytes of its ids; kept by the worker process over its tasks."""
    bpe = vocabulary(path)
    return Memo(lambda chunk: np.array(bpe.encode_chunk(chunk), "<u4").tobytes())


@lru_cache(maxsize=2)
def digest_memo(path: str) -> Memo:
    """Chunk to (number of ids, ids in decimal, decoded text)."""
    bpe = vocabulary(path)

    def make_word(word: str) -> tuple[int, bytes, bytes]:
        ids = bpe._ids_of_word(word)
        return len(ids), b" ".join([b"%d" % i for i in ids]), decode_ids(ids, bpe).encode("utf-8")

    of_word = Memo(make_word, MEMO_CHUNKS // 2)

    def make(chunk: str) -> tuple[int, bytes, bytes]:
        if chunk.isascii() and chunk.isalpha():
            return of_word[chunk.lower()]
        found = [f for f in map(of_word.__getitem__, bpe.words_of(chunk)) if f[0]]
        if len(found) == 1:
            return found[0]
        return sum(f[0] for f in found), b" ".join([f[1] for f in found]), b" ".join([f[2] for f in found])

    return Memo(make)


# Control characters that str.split takes for white space and the vocabulary's pattern does not.
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPACE = regex.compile(r"[^\S\x1c-\x1f]+")


def chunks_of(text: str) -> list[str]:
    if any(c in text for c in _ODD_SPACE):
        return [c for c in _SPACE.split(text) if c]
    return text.split()


def encode_text(text: str, bpe: WordBpe, memo: Memo | None = None) -> np.ndarray:
    """Token ids of a whole text as unsigned 32-bit little-endian numbers."""
    if memo is None:
        return np.array([i for c in chunks_of(text) for i in bpe.encode_chunk(c)], "<u4")
    return np.frombuffer(b"".join([memo[c] for c in chunks_of(text)]), "<u4")


def decode_ids(ids, bpe: WordBpe) -> str:
    """Token strings joined by a space, as the library decodes a vocabulary that names no decoder."""
    return " ".join(bpe.names[int(i)] for i in ids)


def encode_documents(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded): whole texts encoded and decoded."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, memo = vocabulary(vocabulary_path), id_memo(vocabulary_path)
        for f in frames:
            ids = [encode_text(t, bpe, memo) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "ids": [i.astype("int32") for i in ids], "decoded": [decode_ids(i, bpe) for i in ids]})

    return texts(docs).mapInPandas(work, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding of whole texts, as digests made in the task."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = digest_memo(vocabulary_path)
        for f in frames:
            rows = []
            for text in f["text"]:
                found = [m for m in map(memo.__getitem__, chunks_of(text)) if m[0]]
                n = sum(m[0] for m in found)
                rows.append((n, hashlib.sha256(b" ".join([m[1] for m in found])).hexdigest(), hashlib.sha256(b" ".join([m[2] for m in found])).hexdigest()))
            done = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            done.insert(0, "doc_id", f["doc_id"].to_numpy())
            yield done

    return texts(docs).mapInPandas(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
