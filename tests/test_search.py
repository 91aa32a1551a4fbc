import numpy as np
from pyspark.sql import functions as F

from docsluice.operators import search


def brute(vectors, k):
    m = np.array(vectors, dtype=float)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    s = np.round(u @ u.T, 9) + 0.0
    return {(q, c) for q in range(len(m)) for c in sorted(range(len(m)), key=lambda c: (-s[q, c], c))[:k]}


def test_both_ways_are_exact(spark):
    """Clusters, many copies of one vector, and zero vectors: a third of all rows are the same."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, 8))
    vectors = [(centres[i % 5] + rng.normal(scale=0.1, size=8)).tolist() for i in range(120)]
    vectors += [centres[0].tolist()] * 60 + [[0.0] * 8] * 3
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id bigint, embedding array<double>")
    chunks, queries = rows.withColumnRenamed("id", "chunk_id"), rows.withColumnRenamed("id", "query_id")
    want = brute(vectors, 4)
    for options in ({}, {"max_shipped_floats": 0, "n_pivots": 6, "block_rows": 16}):
        got = search.top_k(chunks, queries, 4, **options)
        assert {(r["query_id"], r["chunk_id"]) for r in got.collect()} == want


def test_other_dimensions_do_not_meet(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id bigint, embedding array<double>")
    hits = search.top_k(rows.withColumnRenamed("id", "chunk_id"), rows.withColumnRenamed("id", "query_id"), 5)
    assert {(r["query_id"], r["chunk_id"]) for r in hits.select("query_id", "chunk_id").collect()} == {(1, 1), (2, 2)}
    assert hits.select(F.max("hit_rank")).first()[0] == 1


def test_scores_are_computed_in_bounded_tiles():
    for n_queries, n_rows in ((1, 10), (62_500, 10_000), (10, 5_000_000), (3_000_000, 5), (0, 7)):
        seen = 0
        for q, r in search._tiles(n_queries, n_rows):
            assert (q.stop - q.start) * (r.stop - r.start) <= max(search.TILE_SCORES, 1024)
            seen += (q.stop - q.start) * (r.stop - r.start)
            if seen > 20 * search.TILE_SCORES:
                break
        else:
            assert seen == n_queries * n_rows


def frames(spark, vectors, every=1):
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, embedding array<double>")
    return rows.withColumnRenamed("id", "chunk_id"), rows.where(F.col("id") % every == 0).withColumnRenamed("id", "query_id")


def test_rows_shipped_in_two_passes_are_bounded(spark):
    """Clusters well apart: a slice of queries needs little more than its own cluster, whatever the table holds."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 12))
    shipped = {}
    for n in (2000, 4000):
        vectors = centres[rng.integers(0, 40, n)] + rng.normal(scale=0.02, size=(n, 12))
        vectors[5:n // 3] = vectors[5]  # a third of all rows are the same
        chunks, queries = (f.withColumnRenamed("embedding", "v") for f in frames(spark, vectors))
        met = search._meetings(chunks, queries, 5, None, 256).groupBy("flag").count().collect()
        shipped[n] = {r["flag"]: r["count"] for r in met}
        assert shipped[n][0] <= 2 * n
        got = search.top_k(*frames(spark, vectors, 50), 5, max_shipped_floats=0, block_rows=256)
        u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        scores = np.round(u[::50] @ u.T, 9) + 0.0
        want = {(q * 50, c) for q, row in enumerate(scores) for c in sorted(range(n), key=lambda c: (-row[c], c))[:5]}
        assert {(r["query_id"], r["chunk_id"]) for r in got.collect()} == want
    # The hot third meets itself: its rows go to each slice of its queries.
    assert shipped[2000][1] < 2000 * 8 and shipped[4000][1] < 4000 * 12


def test_more_neighbours_than_rows_and_long_ids(spark):
    big = 2**60
    rows = [(big + i, [1.0, float(i)]) for i in range(6)] + [(big + 100, [0.0, 0.0]), (big + 101, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    hits = search.top_k(df.withColumnRenamed("id", "chunk_id"), df.withColumnRenamed("id", "query_id"), 50, max_shipped_floats=0, n_pivots=3, block_rows=2).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in hits} == {(a, b) for a, v in rows for b, w in rows if len(v) == len(w)}
    names = df.select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("chunk_id"), "embedding")
    mixed = search.top_k(names, df.withColumnRenamed("id", "query_id"), 2, max_shipped_floats=0, block_rows=2).collect()
    assert len(mixed) == 7 * 2 + 1 and all(r["chunk_id"].startswith("n") for r in mixed)
    none = search.top_k(names.where("false"), df.withColumnRenamed("id", "query_id"), 2, max_shipped_floats=0)
    assert none.count() == 0


def test_vectors_without_clusters_ship_by_size(spark, monkeypatch):
    """Bounds leave every cell: a row goes once to each slice, and slices are as few as their size allows."""
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(1500, 12))
    vectors[700:900] = vectors[7]
    chunks, queries = (f.withColumnRenamed("embedding", "v") for f in frames(spark, vectors))
    met = {r["flag"]: r["count"] for r in search._meetings(chunks, queries, 5, None, 64).groupBy("flag").count().collect()}
    assert met == {0: 1500, 1: 1500}
    monkeypatch.setattr(search, "SLICE_FLOATS", 12 * 300)
    monkeypatch.setattr(search, "PART_FLOATS", 12 * 400)
    met = {r["flag"]: r["count"] for r in search._meetings(chunks, queries, 5, None, 64).groupBy("flag").count().collect()}
    assert met[1] <= 10 * 1500 and met[0] <= 4 * 1500
    got = search.top_k(*frames(spark, vectors), 5, max_shipped_floats=0, n_pivots=16, block_rows=64)
    assert {(r["query_id"], r["chunk_id"]) for r in got.collect()} == brute(vectors, 5)


def test_nearest_keeps_ties_of_smaller_ids():
    rng = np.random.default_rng(5)
    rows = search._unit(np.round(rng.normal(size=(9000, 3)), 1))  # many equal vectors
    ids = rng.permutation(9000)
    best = search._Nearest(rows[:40], 6)
    for at in range(0, 9000, 1000):
        best.add(rows[at : at + 1000], ids[at : at + 1000])
        best.floors()
    found = best.frame(np.arange(40))
    scores = np.round(rows[:40] @ rows.T, 9) + 0.0
    want = {(q, int(ids[c])) for q in range(40) for c in sorted(range(9000), key=lambda c: (-scores[q, c], ids[c]))[:6]}
    assert set(zip(found["query_id"], found["chunk_id"])) == want
