"""Rows on which queries once differed from their SQL, as small tables of their own."""

import pytest
from pyspark.sql import functions as F

from docsluice.plans import QUERIES
from tests.oracle import compare, connect

LONG = "to. " * 900


@pytest.fixture
def folder(spark, tmp_path):
    def write(name, rows, schema):
        path = tmp_path / f"{name}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).toPandas().to_parquet(path, index=False)

    page = '<html><head><title>{t}</title></head><body><h1>{t}</h1><p>{body}</p></body></html>'
    pages = [(1, "https://a.example.org/de/1", "x" * 720), (2, "https://a.example.org/de/2", "x" * 722), (3, "https://a.example.org/fr/3", "x" * 900),
             (4, "https://a.example.org/en/4", page.format(t="to.", body=LONG)), (5, "https://a.example.org/en/5", page.format(t="Name of a page", body=LONG))]
    write("pages", pages, "page_id long, url string, html string")
    docs = [(i, "a text", "en", "src1", n) for i, n in enumerate((725, 1225, 2500, 3975, 9000))]
    write("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    write("labels", [(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["compliance_matrix", "snapshot_warnings", "is_login_wall", "snapshot_quality_warnings", "accept_valid"])
def test_same_as_sql(spark, folder, name):
    same, note = compare(spark, connect(folder), name, folder)
    assert same, note


def test_accept_valid_parses_once(spark, folder):
    plan = QUERIES["accept_valid"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse") < 10  # names within the one call; more than sixty before


def test_card_reads_its_page_once(spark):
    """The page and its text are values of one struct; patterns do not compute them anew."""
    from docsluice.functions import html as hx
    from docsluice.operators import cards

    page = "<p>Заказчик: ОАО Мир</p><!-- x --><tr><td>Ключ :</td><td>a  b</td><td></td><td>c &amp;&nbsp;d</td></tr><dt>Срок</dt> <dd><b>5</b> дней</dd>"
    html = hx.strip_comments(F.col("html"))
    rows = spark.createDataFrame([(page,)], "html string").select(cards.labelled_fields(html, hx.strip_html(html)).alias("f"))
    assert rows._jdf.queryExecution().analyzed().toString().count("<!--") == 2
    found = {f["key"]: f["value"] for f in rows.first()["f"]}
    assert found["Ключ"] == "a b c & d" and found["Срок"] == "5 дней"


def test_footer_marks_in_any_case(spark):
    from docsluice.operators import cards

    body = "текст " * 20
    rows = [(body + "РЕСПУБЛИКАНСКОЕ унитарное  предприятие x",), (body + "© y",), (body + "2013 - 2026",), (body + "no mark",)]
    out = [r[0] for r in spark.createDataFrame(rows, "t string").select(cards.truncate_site_chrome(F.col("t"))).collect()]
    assert out == [body.rstrip(), body.rstrip(), body.rstrip(), body + "no mark"]


def test_replies_are_parsed_once(spark, folder):
    """A filter on the parsed reply was pushed below the spread of the scan, with the whole parsing in it."""
    plan = QUERIES["normalize_claims"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1  # two before
    assert plan.count("regexp_replace") < 8  # 52 before


def test_lenient_json_of_odd_replies(spark):
    from docsluice.functions import json as js

    rows = ['```json\n{"a":1}\n```', '}{"a":1,, ,}x', '{"a":[1,2 , ]}', "}{", "{x", "", None, "{'a':'b'}", "text {\"a\":2} ``` "]
    frame = spark.createDataFrame([(r,) for r in rows], "r string")
    out = [r[0] for r in frame.select(F.to_json(js.lenient_json(F.col("r")))).collect()]
    assert out == ['{"a":1}', '{"a":1}', '{"a":[1,2]}', None, None, None, None, '{"a":"b"}', '{"a":2}']
    commas = spark.createDataFrame([("a" + "," * 9 + "}",), (", , ]",), ("[,],}",)], "r string")
    assert [r[0] for r in commas.select(js.without_trailing_commas(F.col("r"))).collect()] == ["a,}", "]", "[]}"]


def test_parser_results_are_read_once(spark, folder):
    rows = QUERIES["read_parser_results"](spark, folder)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 1  # two before, joined
    same, note = compare(spark, connect(folder), "read_parser_results", folder)
    assert same, note
