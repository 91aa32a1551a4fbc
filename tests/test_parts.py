"""Numbered parts join to the whole text; left-out rows add up; bundles and rules keep every row."""

import random

import pytest
from pyspark.sql import functions as F

from docsluice.functions.ranking import distributed_sum, ordered_bucket
from docsluice.operators import assembly, inventory, prompts
from docsluice.operators.parts import numbered_parts, with_ends


def joined(rows, key="tender_id"):
    out = {}
    for r in sorted(rows, key=lambda r: (r[key], r["part"])):
        text = out.setdefault(r[key], "")
        assert r["start"] == len(text)
        out[r[key]] = text + r["text"]
    return out


@pytest.mark.parametrize("chars", [1, 7, 50, 100_000])
def test_parts_of_a_hot_key(spark, chars):
    rng = random.Random(chars)
    rows = [("hot" if i % 10 else f"k{i % 3}", i, "".join(rng.choice("ab é🙂\n") for _ in range(rng.choice([0, 1, 5, 40])))) for i in range(300)]
    rows += [("none", 1, None), ("empty", 1, "")]
    df = spark.createDataFrame(rows, "tender_id string, ord int, text string").repartition(7)
    got = numbered_parts(df, "tender_id", ["ord"], [ordered_bucket(F.col("ord"), df, 8)], "--", chars).collect()
    assert all(len(r["text"]) <= chars for r in got)
    want = {}
    for key, _, text in sorted(rows, key=lambda r: r[1]):
        if text is not None:
            want[key] = text if key not in want else want[key] + "--" + text
    assert joined(got) == {k: w for k, w in want.items() if w}


def test_ends_and_trim(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y \n ")], "tender_id string, ord int, text string")
    ends = spark.createDataFrame([("a", "["), ("b", "[")], "tender_id string, text string")
    pieces = with_ends(df, "tender_id", ends, ends.withColumn("text", F.lit("]")))
    got = joined(numbered_parts(pieces, "tender_id", ["_rank", "ord"], [F.col("_rank")], "", 3).collect())
    assert got == {"a": "[xy \n ]", "b": "[]"}
    assert joined(numbered_parts(df, "tender_id", ["ord"], [F.lit(0)], "\n", 3, trim_end=True).collect()) == {"a": "x\ny"}
    assert numbered_parts(df.where("false"), "tender_id", ["ord"], [F.lit(0)]).count() == 0


def test_sums_with_ties_and_nulls(spark):
    rows = spark.range(500).select((F.when(F.col("id") < 400, None).otherwise(F.col("id") % 3)).alias("k"), (F.col("id") % 50).alias("o"), (F.col("id") % 7 + 1).alias("v"))
    got = {}
    for r in distributed_sum(rows, ["k"], ["o"], [ordered_bucket(F.col("o"), rows, 8)], F.col("v"), whole="w").collect():
        got.setdefault(r["k"], []).append((r["start"], r["v"], r["o"], r["w"]))
    assert len(got) == 4
    for found in got.values():
        found.sort()
        assert [f[0] for f in found] == [sum(v for _, v, _, _ in found[:i]) for i in range(len(found))]
        assert [f[2] for f in found] == sorted(f[2] for f in found) and {f[3] for f in found} == {sum(f[1] for f in found)}


def test_left_out_rows_add_up(spark):
    files = spark.range(200).select(
        F.when(F.col("id") % 9 == 0, "b").otherwise("hot").alias("tender_id"), F.col("id").alias("file_id"), F.format_string("n%03d", "id").alias("name"),
        F.repeat(F.lit("ab "), (F.col("id") % 30).cast("int")).alias("text"),
    )
    kept = {r["tender_id"]: r["corpus"] for r in assembly.assemble_by_budget(files, 700).collect()}
    left = assembly.left_out(files, 700).collect()
    sizes = {(r["tender_id"], r["file_id"]): len(r["text"]) for r in files.collect()}
    for key, corpus in kept.items():
        out = sum(r["left_chars"] for r in left if r["tender_id"] == key)
        whole = sum(n for (k, _), n in sizes.items() if k == key)
        shown = sum(r["kept_chars"] for r in left if r["tender_id"] == key) + sum(n for (k, i), n in sizes.items() if k == key and not any(r["file_id"] == i for r in left))
        assert out + shown == whole and 0 < shown < 700
        assert len(corpus) <= 700 + len(assembly.CUT_BUDGET)
    whole = joined(assembly.assemble_files(files, part_chars=100).collect())
    assert all(whole[k].startswith(c.removesuffix(assembly.CUT_BUDGET)) for k, c in kept.items())


def test_bundle_rows_are_numbered(spark):
    files = spark.range(60).select(F.when(F.col("id") < 50, 1).otherwise(2).alias("tender_id"), F.format_string("f%02d", F.lit(59) - F.col("id")).alias("name"))
    got = inventory.agent_bundle({"a": files, "b": files.withColumn("size", F.lit(3))}, {"a": "name", "b": "name"}).collect()
    assert len(got) == 120 and {r["size"] for r in got if r["list"] == "a"} == {None}
    for key in (1, 2):
        mine = sorted((r["nth"], r["name"]) for r in got if r["list"] == "a" and r["tender_id"] == key)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [x for _, x in mine] == sorted(x for _, x in mine)


def test_price_policy(spark):
    rows = [(k, bool(k & 1), bool(k & 2), bool(k & 4), bool(k & 8)) for k in range(16)]
    got = {r["tender_id"]: r["policy"] for r in prompts.price_policy(spark.createDataFrame(rows, "tender_id int, has_quote boolean, absurd boolean, below_threshold boolean, has_reduction boolean")).collect()}
    for k, quote, absurd, below, reduction in rows:
        assert ("use_agreed_price" in got[k]) == quote
        assert ("agree_price" in got[k]) == (not quote and (absurd or below or not reduction))
        assert ("opening_price" in got[k]) == (reduction and (quote or not (absurd or below)))
