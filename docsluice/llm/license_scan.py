"""License notices in texts: exact phrases, and short notices with a bounded number of errors.

A text is lower-cased (A-Z) and read as words of letters, digits and non-ASCII characters, joined by one space.  Exact
phrases are places where their words stand one after the other.  A notice of the fuzzy list may differ by ``errors``
letters: it is split into ``errors + 1`` seeds, of which at least one must stand unchanged (pigeonhole), one automaton
finds all seeds in one pass, and where a seed stands the regex library's bounded-error matching verifies the notice and
reports its span.  Every whole text is read; the automaton and the notices travel with the task.

A null text is empty and has no words.  Rows with a null doc_id are scanned too.  Repeated rows get repeated rows.  An
empty table gives an empty result.  Columns other than doc_id and text play no part.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame

from docsluice.llm.common import texts

# Exact phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Short notices that are also found with errors, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "this work is licensed under the gnu general public license": "gpl",
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "all rights reserved": "reserved",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "mozilla public license": "mpl",
    "released into the public domain": "public-domain",
    "proprietary and confidential": "proprietary",
}
LETTERS_PER_ERROR, MAX_ERRORS = 10, 3  # a notice of n letters may have n // 10 errors, 3 at most

_TABLE = bytes(b + 32 if 65 <= b <= 90 else (b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))


def plain(text: str) -> str:
    """Words joined by one space."""
    return b" ".join(text.encode("utf-8").translate(_TABLE).split()).decode("utf-8")


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """The notice in ``errors + 1`` parts, each with its start."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


class Scanner:
    def __init__(self, phrases: tuple, notices: tuple):
        self.labels = dict(phrases)
        self.exact = regex.compile("(?<![^ ])(?:" + "|".join(map(regex.escape, sorted(self.labels, key=lambda p: (-len(p), p)))) + ")(?![^ ])") if phrases else None
        self.notices = []
        self.automaton, found = ahocorasick.Automaton(), {}
        for notice, label in notices:
            errors = min(MAX_ERRORS, len(notice) // LETTERS_PER_ERROR)
            pattern = regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={errors}}}")
            self.notices.append((label, len(notice), errors, pattern))
            for start, seed in seeds(notice, errors):
                found.setdefault(seed, []).append((len(self.notices) - 1, start))
        for seed, uses in found.items():
            self.automaton.add_word(seed, (len(seed), uses))
        if found:
            self.automaton.make_automaton()

    def phrases(self, body: str) -> list[tuple[int, str]]:
        """(place, label) of each exact phrase; places may overlap."""
        if self.exact is None:
            return []
        return [(m.start(), self.labels[m.group()]) for m in self.exact.finditer(body, overlapped=True)]

    def fuzzy(self, body: str) -> list[tuple[int, int, str, int]]:
        """(start, stop, label, errors) of each notice found within its errors."""
        if not self.notices:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for stop, (size, uses) in self.automaton.iter(body):
            for which, start in uses:
                _, length, errors, _ = self.notices[which]
                head = stop + 1 - size - start
                windows.setdefault(which, []).append((max(0, head - errors), min(len(body), head + length + errors)))
        out = []
        for which, spans in windows.items():
            label, _, _, pattern = self.notices[which]
            spans.sort()
            at = 0
            while at < len(spans):
                lo, hi = spans[at]
                at += 1
                while at < len(spans) and spans[at][0] <= hi:
                    hi = max(hi, spans[at][1])
                    at += 1
                out += [(m.start(), m.end(), label, sum(m.fuzzy_counts)) for m in best_matches(pattern, body, lo, hi)]
        return out

    def scan(self, text: str) -> tuple:
        body = plain(text)
        n_words = body.count(" ") + 1 if body else 0
        exact, near = self.phrases(body), self.fuzzy(body)
        if not exact and not near:
            return n_words, 0, None, None, "", "", 0.0, []
        spaces = [i for i, c in enumerate(body) if c == " "]
        word = lambda at: bisect.bisect_left(spaces, at)
        base = sorted({label for _, label in exact})
        labels = sorted({*base, *(x[2] for x in near)})
        score = 1.0 if exact else max(1 - e / (stop - start) for start, stop, _, e in near)
        spans = [(word(start), word(stop - 1), label, e) for start, stop, label, e in sorted(near)]
        places = [word(at) for at, _ in exact]
        return n_words, len(exact), min(places, default=None), max(places, default=None), ",".join(base), ",".join(labels), score, spans


def best_matches(pattern: regex.Pattern, body: str, lo: int, hi: int) -> list[regex.Match]:
    """The best match of a stretch, then those of what is left in front of it and behind it, until none is left."""
    out, left = [], [(lo, hi)]
    while left:
        lo, hi = left.pop()
        m = pattern.search(body, lo, hi) if lo < hi else None
        if m is not None:
            out.append(m)
            left += [(lo, m.start()), (m.end(), hi)]
    return out


@lru_cache(maxsize=4)
def scanner(phrases: tuple, notices: tuple) -> Scanner:
    return Scanner(phrases, notices)


def scan_documents(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) per document.

    ``spans`` are the fuzzy finds: first and last word, label, errors.
    """
    given = tuple(phrases.items()), tuple(notices.items())

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = scanner(*given).scan
        for f in frames:
            rows = [scan(t) for t in f["text"]]
            yield pd.DataFrame({
                "doc_id": f["doc_id"],
                "n_words": [r[0] for r in rows], "n_base": [r[1] for r in rows],
                "first_word": pd.array([r[2] for r in rows], dtype="Int64"), "last_word": pd.array([r[3] for r in rows], dtype="Int64"),
                "base_labels": [r[4] for r in rows], "labels": [r[5] for r in rows], "score": [float(r[6]) for r in rows],
                "spans": [[{"first": s[0], "last": s[1], "label": s[2], "errors": s[3]} for s in r[7]] for r in rows],
            })

    return texts(docs).mapInPandas(
        work,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<first: long, last: long, label: string, errors: int>>",
    )
