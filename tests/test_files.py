import shutil

import pytest
from pyspark.sql import functions as F

from docsluice.functions.ranking import distributed_rank, ordered_bucket
from docsluice.operators import assembly, corpus, extraction, ingest, inventory
from docsluice.session import spread
from docsluice.sources import indexing, providers, readers, sinks


@pytest.fixture
def folder(tmp_path):
    for name, text in {"a/x.txt": "раз " * 400, "a/y.MD": "два", "b/z.pdf": "%PDF", "node_modules/q.txt": "нет", "b/w.csv": "1,2"}.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path


def test_scan_index_and_resume(spark, folder):
    root, index = str(folder / "in"), str(folder / "index")
    texts = readers.scan_text_corpus(spark, root)
    assert [r["path"] for r in texts.orderBy("path").collect()] == ["a/x.txt", "a/y.MD", "b/w.csv"]
    assert readers.scan_text_corpus(spark, root, max_files=None).count() == 3
    assert readers.scan_text_corpus(spark, root, max_files=2).count() == 2
    built = corpus.build_index(texts, corpus.hashing_embedder(8), max_chars=500)
    sinks.write_chunk_index(built, index)
    (folder / "index" / "part-99999.json").write_text("\n{broken\n")
    indexed = readers.read_chunk_index(spark, index)
    n = indexed.count()
    assert n >= 5 and indexed.first()["metadata"]["chunk_count"] >= 1
    assert corpus.build_index(texts, corpus.hashing_embedder(8), indexed, max_chars=500).count() == 0
    scan = corpus.scan_counts(readers.list_files(spark, root))
    row = sinks.write_index_manifest(corpus.manifest(indexed, scan, {"model": "h"}), str(folder / "manifest"))
    assert row["chunk_count"] == n and row["dimensions"] == 8 and row["files_scanned"] == 3
    with pytest.raises(corpus.EmptyIndex):
        sinks.write_index_manifest(corpus.manifest(indexed.limit(0), scan, {}), str(folder / "manifest2"))


def test_index_job_goes_on_where_it_stopped(spark, folder):
    root, index = str(folder / "in"), str(folder / "job")
    asked = spark.sparkContext.accumulator(0)
    plain = corpus.hashing_embedder(8)

    def embed(texts):
        asked.add(len(texts))
        return plain(texts)

    row = indexing.build(spark, root, index, embed, "h", max_chars=500)
    assert row["files_scanned"] == 3 and asked.value == row["chunk_count"] >= 5
    shutil.rmtree(folder / "job" / "manifest")
    with pytest.raises(corpus.IncompatibleResume):
        indexing.build(spark, root, index, embed, "other", max_chars=500)
    (folder / "in" / "a" / "new.txt").write_text("новый файл")
    again = indexing.build(spark, root, index, embed, "h", max_chars=500)
    assert again["chunk_count"] == row["chunk_count"] + 1 == asked.value
    (folder / "empty").mkdir()
    with pytest.raises(corpus.EmptyIndex):
        indexing.build(spark, str(folder / "empty"), str(folder / "job2"), embed, "h")
    assert not (folder / "job2" / "manifest").exists()


def test_ranks_put_nulls_first_and_survive_outliers(spark):
    values = [None, 1, 2, 3, 10**12, None] + [7] * 90
    rows = spark.createDataFrame([("k", v, i) for i, v in enumerate(values)], "k string, o bigint, i int")
    ranked = distributed_rank(rows, ["k"], ["o", "i"], [ordered_bucket(F.col("o"), rows, 16)])
    got = [r["i"] for r in ranked.orderBy("rank").collect()]
    assert got == sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))
    words = spark.createDataFrame([("k", w, 0) for w in ["b", "a", None, "zz", "c"]], "k string, o string, i int")
    ranked = distributed_rank(words, ["k"], ["o"], [ordered_bucket(F.col("o"), words, 4)])
    assert [r["o"] for r in ranked.orderBy("rank").collect()] == [None, "a", "b", "c", "zz"]


def test_building_a_spread_scan_runs_no_job(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey")
    spark.sparkContext.setJobGroup("spread", "none")
    spread(table)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("spread")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_resume_rules():
    assert corpus.resume_allowed(True, False) and not corpus.resume_allowed(True, True, True)
    corpus.check_build_state(None, {})
    with pytest.raises(corpus.IncompatibleResume):
        corpus.check_build_state({"max_chars": 500, "overlap": None}, {"max_chars": 600, "overlap": None})


def test_providers(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id int, prompt string")
    assert providers.complete(rows, batch=2).where("prompt = reply").count() == 5
    blobs = spark.createDataFrame(
        [("a.txt", "", bytearray("текст ".encode())), ("b.pdf", "", bytearray(b"%PDF")), ("c.txt", "", bytearray(b" "))],
        "name string, mime string, content binary",
    )
    got = {r["name"]: r for r in extraction.extract_texts(blobs, lambda c, n, m: ("x" * 30, None, "pdf-parse"), max_chars=20).collect()}
    assert got["a.txt"]["text"] == "текст" and got["b.pdf"]["truncated"] and got["c.txt"]["error"] == "пустой текст"


def test_attachments(spark):
    rows = [
        ("a.pdf", bytearray(b"%PDF-1.4 0123456789"), "", True), ("b.docx", bytearray(b"PK\x03\x04" + b"0" * 20), "", True),
        ("c.doc", bytearray(b"\xd0\xcf\x11\xe0" + b"0" * 20), "", True), ("d.pdf", bytearray(b"<html><body>login page</body>"), "", False),
        ("e.pdf", bytearray(b"%PDF-1.4"), "", False), ("f.pdf", bytearray(b"0" * 30), "", False),
        ("g.pdf", bytearray(b"%PDF-1.4 0123456789"), "text/html", False),
    ]
    df = spark.createDataFrame(rows, "name string, content binary, type string, want boolean")
    checked = df.select("want", ingest.attachment_ok(F.col("content"), F.col("name"), F.col("type")).alias("r"))
    assert all(r["want"] == r["r"]["ok"] for r in checked.collect())


def test_unique_names_with_collisions(spark):
    names = ["a.txt", "a (2).txt", "a.txt", "a.txt", "b", "b", "a (2).txt", "c.pdf", "b (2)", "d.md", "d.md"]
    rows = spark.createDataFrame([("f", i, n) for i, n in enumerate(names)], "folder string, ord int, name string")
    used, want = set(), []
    for n in names:
        dot = n.rfind(".")
        base, ext = (n[:dot], n[dot:]) if dot > 0 else (n, "")
        c, i = n, 2
        while c in used:
            c, i = f"{base} ({i}){ext}", i + 1
        used.add(c)
        want.append(c)
    got = ingest.unique_names(rows).orderBy("ord").collect()
    assert [r["dest_name"] for r in got] == want


def test_distributed_rank_with_a_hot_key(spark):
    rows = spark.range(1000).select((F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 7)).alias("k"), (F.col("id") * 7919 % 1009).alias("o"))
    ranked = distributed_rank(rows, ["k"], ["o"], [ordered_bucket(F.col("o"), rows, 16)])
    got = {}
    for r in ranked.collect():
        got.setdefault(r["k"], []).append((r["o"], r["rank"]))
    for pairs in got.values():
        assert [n for _, n in sorted(pairs)] == list(range(1, len(pairs) + 1))


def test_budget_is_never_exceeded(spark):
    rows = spark.range(3000).select(F.lit("t").alias("tender_id"), F.col("id").alias("file_id"), F.format_string("n%05d", "id").alias("name"), F.lit("abc " * 5).alias("text"))
    out = assembly.assemble_by_budget(rows, 5000).first()
    assert len(out["corpus"]) <= 5000 + len(assembly.CUT_BUDGET)
    one = assembly.assemble_by_budget(rows, 5000, salts=1).first()
    assert one["corpus"] == out["corpus"] and one["n_files"] == out["n_files"]


def test_deep_and_cyclic_trees(spark):
    mime = inventory.FOLDER_MIME
    nodes = [(f"d{i}", f"d{i - 1}" if i else "root", f"d{i}", mime) for i in range(40)]
    nodes += [("c1", "c2", "c1", mime), ("c2", "c1", "c2", mime), ("f", "d4", "f.txt", "text/plain"), ("g", "d35", "g.txt", "text/plain"), ("h", "c1", "h", "x")]
    df = spark.createDataFrame(nodes, "id string, parent_id string, name string, mime string")
    got = {r["id"]: r["path"] for r in inventory.tree_paths(df, "root", max_depth=30).collect()}
    assert got == {"f": "d0/d1/d2/d3/d4/f.txt"}
    whole = {r["id"]: r["path"] for r in inventory.tree_paths(df, "root").collect()}
    assert whole == {**got, "g": "/".join(f"d{i}" for i in range(36)) + "/g.txt"}


def test_rendered_sink(spark, tmp_path):
    lines = spark.createDataFrame([("k", i, f"line {i}") for i in range(50)], "key string, n int, line string")
    sinks.write_markdown(lines, str(tmp_path / "md"), "key", ["n"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "md" / "key=k").glob("*.txt")))
    assert text.split("\n")[:50] == [f"line {i}" for i in range(50)]


def test_replace_latest(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_latest(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), path, ["k"])
    sinks.replace_latest(spark.createDataFrame([("a", 2)], "k string, v int"), path, ["k"])
    assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 1)}


def test_render_markdown_keeps_every_line(spark, tmp_path):
    from docsluice.plans import QUERIES

    spark.createDataFrame([(7, "PERU")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    suppliers = spark.range(300).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("s"), "id").alias("s_name"), F.lit(7).alias("s_nationkey"))
    suppliers.repartition(4).write.parquet(str(tmp_path / "supplier.parquet"))
    parts = QUERIES["render_markdown"](spark, str(tmp_path)).orderBy("part").collect()
    text = "".join(r["text"] for r in parts)
    assert len(parts) > 1 and [r["start"] for r in parts] == [sum(len(q["text"]) for q in parts[:i]) for i in range(len(parts))]
    assert text.split("\n") == ["# PERU"] + [f"| s{i} | a\\|b PERU |" for i in range(300)]


def test_a_tree_is_listed_and_read_by_tasks(spark, tmp_path):
    want = {}
    for i in range(60):
        path = tmp_path / f"f{i % 3}" / ("deep" if i % 2 else "") / f"{i}.txt"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"\xff" if i == 7 else f"text {i}".encode())
        want[str(path.relative_to(tmp_path))] = "�" if i == 7 else f"text {i}"
    (tmp_path / "top.txt").write_text("")
    for name in ("_SUCCESS", ".hidden", "f0/_x", "f0/.y"):
        (tmp_path / name).write_text("no")
    want["top.txt"] = ""
    listing, texts = readers.list_files(spark, str(tmp_path)), readers.read_text_folder(spark, str(tmp_path))
    assert listing.inputFiles() == [] == texts.inputFiles()  # the driver holds no names of files
    assert {r["path"]: r["length"] for r in listing.collect()} == {k: len(v.encode()) - 2 * (v == "�") for k, v in want.items()}
    assert {r["file_id"]: r["text"] for r in texts.collect()} == want
    assert {(r["folder"], r["name"]) for r in texts.collect()} >= {("", "top.txt"), ("f0", "0.txt"), ("f1/deep", "1.txt")}
    with pytest.raises(Exception, match="no folder"):
        readers.list_files(spark, str(tmp_path / "absent")).collect()


def test_texts_of_a_folder_are_read_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(text):
        made.add(1)
        return text

    rows = spark.createDataFrame([("a", f"{i}", f"{i}.txt", f"text {i}") for i in range(40)], "folder string, file_id string, name string, text string")
    out = assembly.folder_texts(rows.withColumn("text", F.udf(seen)("text"))).collect()
    assert len(out) == 1 and made.value <= 80  # a row passes a filter and a column at most
