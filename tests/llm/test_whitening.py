"""Whitening against exact integer arithmetic in plain Python and numpy's eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from docsluice.llm import whitening

NAN, INF = float("nan"), float("inf")


def brute(vectors):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = [[float(Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)]
    e, u = np.linalg.eigh(np.array(cov))
    e, u = e[::-1], u[:, ::-1]
    deviation = [sum((n * c - m) ** 2 for c, m in zip(r, s)) for r in x]
    white = np.array([[float(Fraction(n * c - m, n)) for c, m in zip(r, s)] for r in x]) @ u / np.sqrt(np.maximum(e, 1e-300))
    return n, deviation, white, e


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(700, 12)) @ np.diag(np.linspace(3, 0.4, 12)) + rng.normal(size=12)).astype(np.float32)
    x[300:500] = x[7]  # a hot vector
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, n int, whitened string, component int").repartition(parts)


def check(got, ids, vectors, components):
    n, deviation, white, e = brute(vectors)
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], []).append(r)
    sign = None
    for k, i in enumerate(ids):
        mine = sorted(by_row[i], key=lambda r: r["component"])[:components]
        assert [r["component"] for r in mine] == list(range(1, components + 1))
        assert {(r["n"], r["deviation"]) for r in mine} == {(n, deviation[k] if deviation[k] < 1 << 63 else None)}
        z = np.array([r["whitened"] for r in mine])
        sign = np.sign(z) * np.sign(white[k, :components]) if sign is None else sign
        assert np.allclose(z, sign * white[k, :components], rtol=1e-9, atol=1e-9)
        assert np.allclose([r["explained"] for r in mine], e[:components] / e.sum(), rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_against_fractions(spark, data):
    odd = [(5000, None), (5001, []), (5002, [NAN] * 12), (5003, [INF] + [0.0] * 11), (5004, [None] + [0.0] * 11), (5005, [1e300] + [0.0] * 11)]
    got = whitening.whiten(frame(spark, data + odd)).collect()
    assert len(got) == 12 * len(data)
    check(got, [i for i, _ in data], [v for _, v in data], 12)


def test_large_and_negative_entries_and_widths_apart(spark, data):
    wide = [(i, [c * 1e5 for c in v]) for i, v in data[:80]]
    narrow = [(1000 + i, [v[0], -1e4 * v[1], v[2]]) for i, v in data[:60]]
    got = whitening.whiten(frame(spark, wide + narrow + [(None, narrow[0][1]), narrow[3]])).collect()
    assert len(got) == 80 * 12 + 62 * 3
    assert len([r for r in got if r["vec_id"] is None]) == 3 and len([r for r in got if r["vec_id"] == narrow[3][0]]) == 6
    check([r for r in got if r["vec_id"] is not None and r["vec_id"] < 1000], [i for i, _ in wide], [v for _, v in wide], 12)


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(i) * 1e9, float(i % 3)]) for i in range(50)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r["deviation"] for r in got} == {None} and got[0]["identity_error"] < 1e-6


def test_few_and_equal_vectors(spark, data):
    assert whitening.whiten(frame(spark, data[:1])).count() == 0
    assert whitening.whiten(frame(spark, data).where("false")).count() == 0
    flat = [(i, [1.0, 2.0, 3.0 + (i % 2)]) for i in range(20)]
    got = whitening.whiten(frame(spark, flat)).collect()
    assert len(got) == 20 and {abs(r["whitened"]) for r in got} == {1.0} and {r["explained"] for r in got} == {1.0}
    assert {r["component"] for r in whitening.whiten(frame(spark, data[:5])).collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize("high", [1, 2, 200, 1 << 40])
def test_bit_planes_multiply_exactly(high):
    rng = np.random.default_rng(high % 97)
    y = rng.integers(0, high, size=(130, 7))
    want = y.astype(object).T @ y.astype(object)
    assert (whitening.cross_products(y) == want).all()


def test_limbs_add_up():
    for value in (0, 1, -1, 1 << 30, -(1 << 30), 12345678901234567890123, -98765432109876543210):
        assert sum(part << (whitening.LIMB * k) for k, part in whitening.limbs(value)) == value
        assert all(abs(part) < 1 << 31 for _, part in whitening.limbs(value))


def test_eigenvectors_of_near_equal_values():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    want = np.sort(np.concatenate([[1000.0, 1000.0001, 5, 5], rng.uniform(0.01, 3, 16)]))[::-1]
    v = ((q * want) @ q.T).astype(np.longdouble)
    e, x = whitening.eigen((v + v.T) / 2)
    assert np.allclose(e.astype(float), want, rtol=1e-10)
    assert np.abs(x.T @ x - np.eye(20)).max() < 1e-15
