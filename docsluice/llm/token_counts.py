"""Token counts of a unigram vocabulary by dynamic programming shared along a trie of pre-tokens.

A pre-token is a run of characters that are not white space, with the vocabulary's space mark in front.  The distinct
pre-tokens of a batch are put in a trie; going down it, the forward score of a prefix (the best sum of piece scores
that spells it) is computed once and serves every pre-token that begins so.  A terminal stores its count of tokens,
and a text's count is the sum over its pre-tokens.

Pieces score by their rank: minus the logarithm of (rank + 1).  Characters that no piece spells cost the byte pieces of
their UTF-8 bytes.  Of equal scores the segmentation with fewer tokens counts.  White space is that of str.split.

A null text is empty and has no tokens.  Rows with a null doc_id are counted too.  Repeated rows get repeated rows.  An
empty table gives an empty result.  Columns other than doc_id and text play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from docsluice.llm.bpe import Memo
from docsluice.llm.common import texts

MARK = "▁"  # fixed value: the space mark of the vocabulary file
FEW = 64  # texts whose pre-tokens share one trie


class Unigram:
    """Piece scores from a sentencepiece file; the pieces are read, nothing is trained."""

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        self.scores: dict[str, float] = {}
        rank = 0
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
                continue
            self.scores[model.id_to_piece(i)] = -math.log(rank + 1)
            rank += 1
        self.byte_score = -math.log(rank + 1)  # byte pieces rank behind all others
        self.longest = max(map(len, self.scores), default=1)
        self.counts = Memo(lambda word: self.count_all([word])[word])

    def step(self, word: str, stop: int, forward: list[tuple[float, int]]) -> tuple[float, int]:
        """Best (score, minus tokens) of the first ``stop`` characters, from those of the shorter prefixes."""
        size = len(word[stop - 1].encode("utf-8", "surrogatepass"))
        score, tokens = forward[stop - 1]
        best = (score + size * self.byte_score, tokens - size)
        for start in range(max(0, stop - self.longest), stop):
            piece = self.scores.get(word[start:stop])
            if piece is not None:
                score, tokens = forward[start]
                best = max(best, (score + piece, tokens - 1))
        return best

    def count_all(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of each distinct word: depth first through their trie, which is their sorted order."""
        out, forward, before = {}, [(0.0, 0)], ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del forward[shared + 1 :]
            for stop in range(shared + 1, len(word) + 1):
                forward.append(self.step(word, stop, forward))
            out[word] = -forward[len(word)][1]
            before = word
        return out

    def count_texts(self, batch: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        rows = [[MARK + w for w in t.split()] for t in batch]
        known = self.counts
        fresh = self.count_all({w for w in set().union(*rows) if known.look(w) is None})
        for word, n in fresh.items():
            if len(word) <= 64:
                known.put(word, n)
        return [(len(row), sum(fresh[w] if w in fresh else known[w] for w in row)) for row in rows]


@lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    return Unigram(path)


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) per document."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = unigram(vocabulary_path)
        for f in frames:
            for at in range(0, len(f), FEW):
                some = f.iloc[at : at + FEW]
                counts = model.count_texts(list(some["text"]))
                yield pd.DataFrame({"doc_id": some["doc_id"], "n_words": [c[0] for c in counts], "n_tokens": [c[1] for c in counts]})

    return texts(docs).mapInPandas(work, "doc_id long, n_words long, n_tokens long")

