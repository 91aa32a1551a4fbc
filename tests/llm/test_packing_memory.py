"""Packing among other jobs: small tables of known chunks, the same ids."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from docsluice.llm import common, packing
from docsluice.llm.queries import tokenizer_file


def test_small_tables_give_the_same_ids():
    path, letters = tokenizer_file("word_bpe_49k.json"), "abcdefghijklmnopqrstuvwxyz"
    texts = pa.array([" ".join(f"{letters[i % 26]}{letters[j]}{letters[i // 26]}q, {i * j}" for i in range(200)) for j in range(1, 12)])
    few, many = packing.LibraryIds(path, 60), packing.LibraryIds(path)
    for _ in range(2):
        for got, want in zip(few.encode(texts), many.encode(texts)):
            assert np.array_equal(got, want)
    assert len(few.memo) <= 60 and len(few.memo.old) <= 60 and len(few.words) <= 30 and len(few.words.old) <= 30 < len(many.words)


def test_packing_without_kept_tables_remembers_less(frame, monkeypatch):
    made = []

    def seen(path, known=None):
        made.append(known)
        raise RuntimeError(f"known {known}")

    monkeypatch.setattr(packing, "library_ids", seen)
    for keep, known in ((False, packing.FEW_CHUNKS), (True, packing.KNOWN_CHUNKS)):
        cut = packing.pieces(frame([(1, "a b")]), tokenizer_file("word_bpe_49k.json"), keep_tables=keep)
        try:
            cut.collect()
        except Exception as error:
            assert f"known {known}" in str(error)
        else:
            raise AssertionError("the tables were not asked for")


def _held() -> float:
    """MB of this process that are not mapped files."""
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_a_task_leaves_its_worker_no_memory_that_it_freed():
    def work(batches):
        for n in batches:
            held = [bytes(50_000) for _ in range(n)]  # from the heap, with a last piece that keeps its top in place
            keep.append(bytes(50_000))
            del held
            yield n

    keep = []
    list(work([2_000]))
    loose = _held()
    list(common.lean(work)([2_000]))
    assert _held() < loose - 50 and not common._powers
