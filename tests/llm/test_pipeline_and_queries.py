"""The pipeline stage by stage, and the registered queries on the smallest tables."""

import hashlib

import pytest

import corpus_pipeline
from docsluice.llm.queries import ORACLES, QUERIES
from tests.llm.test_texts import brute_groups, brute_repeats
from tests.oracle import _rows, connect

FOLDER = "/root/testdata/sf0.001"


def test_names():
    assert [n for n in QUERIES if n.startswith("op")] and set(ORACLES) <= set(QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    mine = [tuple(r) for r in frame.collect()]
    assert mine
    if name in ORACLES:
        cursor = connect(FOLDER).execute(ORACLES[name])
        assert _rows([d[0] for d in cursor.description], cursor.fetchall()) == _rows(frame.columns, mine)


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], FOLDER).cache())
    good, single, cut, packed = kept[1:]
    assert good.columns == single.columns == cut.columns == columns
    before = [(r["doc_id"], r["text"]) for r in good.collect()]
    groups = brute_groups(before, 5)
    assert {r["doc_id"] for r in single.collect()} == {i for i, g in groups.items() if g[2]}
    want = brute_repeats([(r["doc_id"], r["text"]) for r in single.collect()], 100)
    for r in cut.collect():
        n, removed, _, digest = want[r["doc_id"]]
        body = r["text"].encode()
        assert len(body) <= n - removed and (len(body) < n - removed or hashlib.sha256(body).hexdigest() == digest)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in cut.collect()}


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0 and "sequence_id" in out.columns
