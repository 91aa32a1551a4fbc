"""Unique names by ranks and gaps against giving them one after the other."""

import random

import pytest

from docsluice.operators import ingest


def one_by_one(rows):
    used, out = set(), {}
    for folder, order, name in sorted(rows, key=lambda r: r[1]):
        dot = name.rfind(".")
        base, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        candidate, i = name, 2
        while (folder, candidate) in used:
            candidate, i = f"{base} ({i}){ext}", i + 1
        used.add((folder, candidate))
        out[order] = candidate
    return out


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "folder string, ord long, name string, base string, number int").repartition(4)
    got = {r["ord"]: r["dest_name"] for r in ingest.unique_names(frame).collect()}
    assert got == one_by_one(rows)
    assert len({(f, got[o]) for f, o, _ in rows}) == len(rows)


def shuffled(rng, names):
    order = list(range(len(names)))
    rng.shuffle(order)
    return [(folder, o, n) for o, (folder, n) in zip(order, names)]


@pytest.mark.parametrize("seed", range(3))
def test_tangled_families(spark, seed):
    rng = random.Random(seed)
    names = []
    for folder in ("f", "g"):
        for _ in range(120):
            base = rng.choice(["a", "b.c", ".rc", "", "x y"])
            tail = "".join(f" ({rng.choice([1, 2, 2, 3, 3, 4, 5, 7, 12, '02', 10**19])})" for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])))
            names.append((folder, base + tail + rng.choice([".pdf", ".pdf", "", "."])))
    check(spark, shuffled(rng, names))


def test_hot_family_with_many_literals(spark):
    rng = random.Random(7)
    names = [("f", "a.pdf")] * 400 + [("f", f"a ({rng.randint(2, 700)}).pdf") for _ in range(400)] + [("g", "b.txt")] * 3
    check(spark, shuffled(rng, names))


def test_literals_before_and_after(spark):
    repeats, literals = [("f", "a.x")] * 6, [("f", f"a ({n}).x") for n in (2, 3, 5, 6, 20)]
    check(spark, [(f, i, n) for i, (f, n) in enumerate(literals + repeats)])
    check(spark, [(f, i, n) for i, (f, n) in enumerate(repeats + literals + repeats)])


def test_what_rounds_leave_open_is_settled_in_order(spark, monkeypatch):
    rounds = ingest._blocked
    monkeypatch.setattr(ingest, "_blocked", lambda literals, keys: rounds(literals, keys, rounds=0))
    rng = random.Random(3)
    check(spark, shuffled(rng, [("f", "a.pdf")] * 60 + [("f", f"a ({rng.randint(2, 90)}).pdf") for _ in range(60)]))


def test_nothing_to_name(spark):
    assert ingest.unique_names(spark.createDataFrame([], "folder string, ord long, name string")).count() == 0
