"""Vector and url operators against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsluice.llm import ann, url_filter, vector_dedup
from docsluice.llm.common import components

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 16))
    x[100:200] = x[:100] + rng.normal(scale=0.12, size=(100, 16))
    x[200:330] = x[7]  # a hot vector
    x[330:350] = 3 * x[8]
    rows = [(i, [float(np.float32(c)) for c in v], int(i % 3 == 0)) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [NAN] + [1.0] * 15, [INF] * 16, [None] + [1.0] * 15, [1.0, 2.0, 3.0], [1.0, 2.0, 3.5], rows[7][1]]
    rows += [(600 + 20 * i, v, 1) for i, v in enumerate(odd)]
    return [*rows, (5000, rows[7][1], None), (None, rows[7][1], 1), rows[7], rows[0]]


@pytest.fixture(scope="module")
def table(spark, vectors):
    return spark.createDataFrame([(*r, "x", 1) for r in vectors], "vec_id long, embedding array<float>, label int, score string, n int").repartition(4)


def good(v):
    return bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)


def test_nearest(vectors, table):
    rows = {i: np.array(v) for i, v, _ in vectors if i is not None and good(v)}
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in (i for i in rows if i % 20 == 0):
        near = sorted((-(rows[q] * v).sum(), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))[:20]
        mine = sorted(got.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(near) + 1))
        assert all(m[1] != q and abs(m[2] - rows[q] @ rows[m[1]]) < 1e-9 for m in mine)
        assert mine == sorted(mine, key=lambda m: (-round(m[2], 12), m[1]))
        hit, total = hit + len({m[1] for m in mine} & {i for _, i in near}), total + len(near)
    assert hit >= 0.9 * total
    assert set(got) == {i for i in rows if i % 20 == 0 and sum(len(v) == len(rows[i]) for v in rows.values()) > 1}


def test_vectors_longer_than_the_samples_longest(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 64)
    monkeypatch.setattr(ann, "SHARD_ROWS", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 6000)] + rng.normal(scale=0.4, size=(6000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # The sample takes the least hashes of ids, so the greatest are outside it.
    last = [r["id"] for r in spark.range(6000).orderBy(F.xxhash64("id").desc()).limit(30).collect()]
    x[last] *= 3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(rows, F.col("vec_id") % 20 == 0, recall_index=3000).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in range(0, 6000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        assert set(np.argsort(-scores)[:20].tolist()) & set(last) <= got[q]


def test_nearest_of_nothing(table):
    assert ann.search(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(table.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0


def test_lists_are_balanced_and_graph_search_finds_the_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 12))
    index = ann.build_index(x, 4000, 20)
    lifted = ann.lift(x, index.top2)
    home = ann.distances(lifted, index.centres).argmin(1)
    assert np.bincount(home).max() < 8 * 256
    d, nearest = ann.search_centres(index, lifted[:500], 1.0)
    assert np.allclose(nearest, ann.distances(lifted[:500], index.centres).min(1))
    assert max(map(len, ann.store_in(index, lifted[:500]))) <= ann.REPLICAS


def test_vector_links(vectors, table):
    rows = {i: (np.array(v), label) for i, v, label in vectors if i is not None and label is not None and good(v)}
    got = {}
    for r in vector_dedup.near_duplicates(table).collect():
        got.setdefault(r["vec_id"], []).append(r)
    assert {i: len(x) for i, x in got.items()} == {i: sum(r[0] == i for r in vectors) for i in {r[0] for r in vectors}}
    ids = sorted(rows)
    links = {i: [j for j in ids if j != i and rows[i][1] == rows[j][1] and len(rows[i][0]) == len(rows[j][0])
                 and rows[i][0] @ rows[j][0] / np.linalg.norm(rows[i][0]) / np.linalg.norm(rows[j][0]) >= 0.93] for i in ids}
    group = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min([group[i], *(group[j] for j in links[i])])
            if low < group[i]:
                group[i], changed = low, True
    for i, found in got.items():
        for r in found:
            if i in rows:
                assert (r["n_links"], r["component_id"], r["kept"]) == (len(links[i]), group[i], group[i] == i)
            else:
                assert (r["n_links"], r["component_id"], r["kept"]) == (0, i, True)


def test_small_blocks_and_lower_recall(vectors, spark):
    rows = [(i, 1, 1, v) for i, v, _ in {r[0]: r for r in vectors if r[0] is not None and good(r[1])}.values() if len(v) == 16]
    groups = spark.createDataFrame(rows, "id long, label long, weight long, v array<float>")
    whole, _ = vector_dedup.links(groups)
    cut, _ = vector_dedup.links(groups, block=16)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))
    less, _ = vector_dedup.links(groups, recall=0.9)
    assert sum(r["n"] for r in less.collect()) >= 0.85 * sum(r["n"] for r in whole.collect())
    assert vector_dedup.near_duplicates(groups.where("false").withColumnsRenamed({"id": "vec_id", "v": "embedding"})).count() == 0


def test_components_of_long_paths_and_hubs(spark):
    rng = random.Random(2)
    order = list(range(300))
    rng.shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000, 1001 + i) for i in range(400)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[1001 + i] == 1000 for i in range(400)) and got[2001] == 2000


URLS = [
    None, "", "no scheme", "http://", "http://ORG/", "http://org", "https://a.Example.ORG/es/x?y#z", "https://example.org/en/1", "https://example.org/en/2", "http://myexample.org/es/",
    "ftp://x.com/fr/", "ftp://x.com/de/1#a", "http://com/fr/", "http://.com/fr/", "http://x.net/fr/", "http://x.org?/es/", "://org/#", "http://a://example.org/es/", "http://example.org/es",
]


def judge(url):
    rest = (url or "").partition("://")[2]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), v, h + p) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, "allow", None))
    return host, path, best[2], best[1]


def test_url_rules(spark):
    rows = list(enumerate(URLS)) + [(None, URLS[6]), (4, URLS[4])] + [(100 + i, f"http://h{i}.{t}/{p}{i}") for i in range(300) for t in ("com", "example.org", "net") for p in ("fr/", "en/", "es/", "")]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, rule string")
    got = sorted((tuple(r) for r in url_filter.judge_urls(pages).collect()), key=repr)
    assert got == sorted(((i, *judge(u)) for i, u in rows), key=repr)
    assert url_filter.judge_urls(pages.where("false")).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules=[]).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("cast(substring(key, 2) as int) % 7 = 3")
    levels = url_filter.build_cascade(listed, universe)
    assert len(levels) > 2
    wrong = universe.where(url_filter.member(levels, F.col("key")) != (F.col("key").substr(2, 9).cast("int") % 7 == 3))
    assert wrong.count() == 0
