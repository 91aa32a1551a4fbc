"""Attachments read by their beginnings, and tables whose changes are seen whole or not at all."""

import pytest
from pyspark.sql import functions as F

from docsluice.operators import ingest
from docsluice.sources import readers, sinks, versions


def test_only_the_beginning_of_an_attachment_is_read(spark, tmp_path):
    rows = [("a.pdf", b"%PDF-1.4 " + b"x" * 5_000_000), ("b.docx", b"PK\x03\x04" + b"y" * 100), ("c.pdf", b""), ("d.pdf", b"<html>" + b"z" * 1000), ("e.pdf", b"%PDF")]
    rows += [(f"n{i}.pdf", b"%PDF-1.4 " + bytes([i]) * 50) for i in range(100)]
    root = str(tmp_path / "files")
    files = spark.createDataFrame(rows, "name string, content binary").repartition(4)
    sinks.write_attachments(files, root)
    sinks.write_attachments(files, root)  # a repeated write leaves the same files
    got = {r["name"]: r for r in readers.read_attachments(spark, root).collect()}
    assert set(got) == {n for n, _ in rows}
    for name, content in rows:
        r = got[name]
        assert (r["size"], r["bytes_read"], bytes(r["head"])) == (len(content), min(500, len(content)), content[:500])
    judged = readers.read_attachments(spark, root).select("name", ingest.attachment_ok(F.col("head"), F.col("name"), F.lit(""), F.col("size")).alias("r"))
    whole = files.select("name", ingest.attachment_ok(F.col("content"), F.col("name"), F.lit("")).alias("r"))
    assert {(r["name"], r["r"]) for r in judged.collect()} == {(r["name"], r["r"]) for r in whole.collect()}
    assert readers.read_attachments(spark, str(tmp_path / "nowhere")).count() == 0


SCHEMA = "k string, part int, v int"


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    current = lambda: {(r["k"], r["part"], r["v"]) for r in readers.read_latest(spark, path, SCHEMA).collect()}
    return path, frame, current


def test_changes_are_seen_whole_or_not_at_all(table):
    path, frame, current = table
    assert current() == set()
    sinks.publish_latest(frame(("a", 1, 1), ("a", 2, 1), ("b", 1, 1)), path, ["k"], token="one")
    assert current() == {("a", 1, 1), ("a", 2, 1), ("b", 1, 1)}
    sinks.publish_latest(frame(("a", 1, 9), ("c", 1, 9)), path, ["k"], publish=False)  # interrupted
    assert current() == {("a", 1, 1), ("a", 2, 1), ("b", 1, 1)}
    sinks.publish_latest(frame(("a", 1, 2), ("c", 1, 2)), path, ["k"], token="two")
    assert current() == {("a", 1, 2), ("b", 1, 1), ("c", 1, 2)}
    sinks.publish_latest(frame(("a", 1, 3)), path, ["k"], token="two")  # repeated
    sinks.publish_latest(frame(("z", 1, 3)), path, ["k"], token="one")
    assert current() == {("a", 1, 2), ("b", 1, 1), ("c", 1, 2)}
    sinks.publish_latest(frame(), path, ["k"])
    assert current() == {("a", 1, 2), ("b", 1, 1), ("c", 1, 2)}


def test_untouched_buckets_keep_their_files(spark, table):
    path, frame, current = table
    sinks.publish_latest(frame(*[(str(i), 0, 0) for i in range(500)]), path, ["k"])
    first = versions.manifest(spark, path)[1]
    sinks.publish_latest(frame(("7", 0, 1)), path, ["k"])
    second = versions.manifest(spark, path)[1]
    assert len(first) == versions.BUCKETS and sum(first[b] != second[b] for b in first) == 1
    assert current() == {(str(i), 0, int(i == 7)) for i in range(500)}


def test_state_is_merged_field_by_field(spark, tmp_path):
    path, schema = str(tmp_path / "states"), "tender_id int, status string, day string"
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    sinks.upsert_state(frame((1, "new", "mon"), (2, "new", None)), path)
    sinks.upsert_state(frame((1, None, "tue"), (3, "x", None)), path, token="t")
    sinks.upsert_state(frame((1, "late", "late")), path, token="t")
    assert {tuple(r) for r in readers.read_latest(spark, path, schema).collect()} == {(1, "new", "tue"), (2, "new", None), (3, "x", None)}


def test_of_two_writers_on_one_version_the_second_fails(spark, table, monkeypatch):
    path, frame, current = table
    sinks.publish_latest(frame(("a", 1, 1)), path, ["k"])
    stale = versions.manifest(spark, path)
    sinks.publish_latest(frame(("a", 1, 2)), path, ["k"])
    monkeypatch.setattr(versions, "manifest", lambda *_: stale)
    with pytest.raises(Exception, match="already exists"):
        sinks.publish_latest(frame(("a", 1, 3)), path, ["k"])
    monkeypatch.undo()
    assert current() == {("a", 1, 2)}
