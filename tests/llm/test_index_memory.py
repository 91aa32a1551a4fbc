"""What the driver holds while an index of vectors is fitted."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from docsluice.llm import ann
from docsluice.llm.vectors import sample


def test_building_an_index_holds_blocks_of_rows_and_not_every_row_with_every_centre():
    x = np.random.default_rng(4).normal(size=(6000, 8))
    tracemalloc.start()
    try:
        index = ann.build_index(x, 1024 * ann.LIST_ROWS, 20)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(index.centres) >= 1024 and index.ratio >= 1
    assert peak < 6000 * 1024 * 8  # one number for each vector and centre


def test_blocks_choose_the_same_lists_as_all_rows_at_once(monkeypatch):
    x = np.random.default_rng(5).normal(size=(700, 6))
    index = ann.build_index(x, 32 * ann.LIST_ROWS, 5)
    lifted, asked = ann.lift(x, index.top2), ann.lift_queries(x[:300], index.top2)
    stored, chosen = ann.store_in(index, lifted), ann.choose_lists(index, asked)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 10_000)
    assert [a.tolist() for a in ann.store_in(index, lifted)] == [a.tolist() for a in stored]
    assert [a.tolist() for a in ann.choose_lists(index, asked)] == [a.tolist() for a in chosen]


def test_a_sample_is_the_vectors_of_the_smallest_hashes(spark):
    rows = spark.range(3000).select("id", F.array(F.col("id").cast("float"), F.lit(1.5).cast("float")).alias("v"))
    hashes = {r["id"]: r["h"] for r in rows.select("id", F.xxhash64("id").alias("h")).collect()}
    wanted = sorted(hashes, key=hashes.get)
    for size in (40, 2900, 5000):
        assert sample(rows, "v", "id", size).tolist() == [[float(i), 1.5] for i in wanted[:size]]


def test_a_sample_of_repeated_ids_is_whole(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("id"), F.array(F.col("id").cast("double")).alias("v"))
    assert sample(rows, "v", "id", 100).shape == (100, 1)
