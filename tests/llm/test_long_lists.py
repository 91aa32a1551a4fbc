"""Lists of many sets that are alike: what a task holds, and how often a pair is reported."""

import tracemalloc

import numpy as np
import pyarrow as pa

from docsluice.llm import minhash
from docsluice.llm.vectors import blocks_and_streams

NAMES = ["path", "part", "flag", "id", "n", "group", "home", "brief", "top", "earlier"]
K = minhash.K


def rows_of(flag, ids, briefs, path=7, earlier=()):
    """Rows of a list as its task gets them: every set a group of its own."""
    n = len(ids)
    own = pa.array(ids, pa.int64())
    whole = lambda v: pa.array(np.full(n, v, np.int64))
    return [whole(path), whole(0), pa.array(np.full(n, flag, np.int32)), own, whole(100), own, own, pa.array([b.astype("<u4").tobytes() for b in briefs], pa.binary()),
            whole(-1), pa.array([list(earlier)] * n, pa.list_(pa.int64()))]


def candidates(*rows):
    batches = [pa.RecordBatch.from_arrays(r, NAMES) for r in rows]
    run = blocks_and_streams(2, minhash._list_pairs(K, 80))
    return [tuple(r.values()) for b in run(iter(batches)) for r in b.to_pylist()]


def test_sets_that_share_all_their_values_take_bounded_memory():
    rng = np.random.default_rng(1)
    ids, common = np.arange(1500), np.sort(rng.choice(2**32, 2 * K, replace=False))
    briefs = [np.sort(rng.permutation(common)[:K]) for _ in ids]  # each shares about half with every other
    tracemalloc.start()
    candidates(rows_of(0, ids, briefs), rows_of(1, ids, briefs))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_a_held_set_is_reported_once_and_a_pair_in_its_first_list():
    common = np.arange(K) + 5
    held, passing = rows_of(0, range(10, 60), [common] * 50), [rows_of(1, [i], [common]) for i in range(10)]
    got = candidates(held, *passing)
    assert len(got) == len(set(got)) == 50 + 10 * 50
    known = [rows_of(1, [i], [common], earlier=[3, i]) for i in range(5, 10)]
    assert candidates(rows_of(0, range(10, 60), [common] * 50, earlier=[3]), *known) == []
    apart = candidates(rows_of(0, range(10, 60), [common] * 50, earlier=[4]), rows_of(1, [3], [common], earlier=[3]))
    assert len(apart) == 2 * 50
