"""Golden rows for rules about Russian text and HTML, which the given tables do not hold."""

from pyspark.sql import functions as F

from docsluice.operators import cards, extraction, grounding, links, policy, prompts
from docsluice.functions import messages as mx

PAGE = """<html><head><title>portal.by - поддержка</title></head><body><!-- x --><h1>Просмотр закупки</h1><h2>Процедура закупки: насосы</h2>
<table><tr><td>Полное наименование заказчика:</td><td>ОАО &#171;Ромашка&#187; &amp; Ко</td><td>г. Минск</td></tr>
<tr><th>Предмет закупки</th><td>Насосы</td></tr><tr><td>Заказчик</td><td>Согласно документации</td></tr>
<tr><td>Общая ориентировочная стоимость</td><td>12 000 BYN</td></tr></table><dl><dt>Отрасль</dt><dd>Машиностроение</dd></dl>
Процедура закупки № 2024-123 Запрос ценовых предложений. +375 17 123 45 67 A.B@Ex.by.
Аукционные документы <a href="/auction/getFile/7?f=detail&n=0">ТЗ.pdf</a> <a href="b/../c.docx?x=1">Договор.docx</a> <a href="/files/edge_browser_settings.pdf">браузер</a>
<p>События в хронологическом порядке</p><p>01.02.2024 10:15 — Размещено приглашение</p><p>05.02.2024 Процедура отменена заказчиком</p> © 2024</body></html>"""
SITE = cards.Site("portal.by")


def snapshot(spark):
    page = spark.createDataFrame([(1, "https://portal.by/tenders/view/1", PAGE)], "page_id int, url string, html string")
    return page, cards.card_snapshot(page, SITE).first().asDict(recursive=True)


def test_card(spark):
    _, card = snapshot(spark)
    assert card["title"] == "Насосы" or card["title"].startswith("Процедура")
    assert [f["key"] for f in card["labelled_fields"]][:2] == ["Отрасль", "Полное наименование заказчика"]
    assert card["structured"]["customer"]["name_address"] == "ОАО «Ромашка» & Ко г. Минск"
    assert card["structured"]["procedure"]["estimated_total_value"] == "12 000 BYN"
    assert card["procedure"] == {"reference": "2024-123", "form": "Запрос ценовых предложений"}
    assert [(e["date"], e["severity"]) for e in card["events"]] == [("01.02.2024 10:15", "info"), ("05.02.2024", "cancel")]
    assert card["phones"] == ["+375 17 123 45 67"] and card["emails"] == ["a.b@ex.by"]


def test_attachment_links(spark):
    page, _ = snapshot(spark)
    found = [(r["url"], r["link_text"]) for r in links.attachment_links(page, SITE).orderBy("ord").collect()]
    assert found == [
        ("https://portal.by/auction/getFile/7?f=detail&n=0", "ТЗ.pdf"), ("https://portal.by/tenders/view/c.docx?x=1", "Договор.docx"),
    ]


def flags(spark, text):
    rows = spark.createDataFrame([(text,)], "corpus string")
    return policy.price_coordination(rows).first()


def test_price_rules(spark):
    assert flags(spark, "проводится процедура улучшения")["has_reduction"]
    assert flags(spark, "Цена лота: 9 999 BYN")["below_threshold"] and not flags(spark, "Цена лота: 10 000 BYN")["below_threshold"]
    assert flags(spark, "начальная цена 1 руб")["absurd"] and not flags(spark, "цена лота 120 BYN")["absurd"]
    assert flags(spark, "Стартовая цена: USD 60")["has_ceiling"]


def test_terms(spark):
    text = "\n".join(
        [
            "предложение должно содержать порядок оплаты", "Начальная цена лота 500 BYN", "Цена лота и срок поставки 10 календарных дней",
            "Банковская гарантия на возврат аванса 10 %", "Предоплата 30 % до отгрузки", "Гарантийный срок не менее 24 месяцев",
        ]
    )
    rows = spark.createDataFrame([(text,)], "corpus string")
    slots = rows.select(policy.first_line_per_slot(F.col("corpus")).alias("s")).first()["s"]
    assert slots["price"].startswith("Начальная") and slots["delivery"].startswith("Цена лота и срок")
    assert slots["payment"].startswith("Предоплата") and slots["warranty"].startswith("Гарантийный")
    plan = policy.terms_gate_plan(rows).first()
    assert plan["mode"] == "no_reduction" and plan["steps_queue"] == list(policy.SLOTS)


def test_text_quality(spark):
    rows = spark.createDataFrame([("a " * 300,), ("ok",), ("слово " * 100,), ("ab\n" * 70,)], "text string")
    got = [(r["too_short"], r["low_cyrillic"], r["fragmented"]) for r in extraction.score_layers(rows).collect()]
    assert got == [(False, True, False), (True, False, False), (False, False, False), (False, False, True)]


def test_grounding(spark):
    corpora = spark.createDataFrame([("t", "Поставка «насосов» в срок до 10 дней. " + "x" * 200)], "tender_id string, corpus string")
    claims = [
        ("t", "1", "self", "a", "b", "", 'Поставка "насосов" в срок'), ("t", "2", "self", "a", "b", "", "короткая"),
        ("t", "3", "manager", "a", "b", "нет такой цитаты здесь", "x" * 150 + "y"), ("none", "4", "self", "a", "b", "", "Поставка насосов в срок"),
    ]
    rows = spark.createDataFrame(claims, "tender_id string, claim_id string, list string, name string, basis string, criteria string, evidence string")
    got = {r["claim_id"]: (r["grounded"], r["kept_criteria"]) for r in grounding.ground_claims(rows, corpora).collect()}
    assert got == {"1": (True, None), "2": (False, None), "3": (False, "—"), "4": (False, None)}
    heads = {r["claim_id"]: r["head_grounded"] for r in grounding.ground_claims(rows, corpora).collect()}
    assert heads == {"1": True, "2": False, "3": True, "4": False}


def test_lenient_replies(spark):
    rows = [(1, "```json\n{\"a\": 1,}\n```"), (2, "текст {'a': 2} конец"), (3, "нет"), (4, '{"a":[1,2,],}')]
    parsed = prompts.read_replies(spark.createDataFrame(rows, "tender_id int, reply string"))
    assert {r["tender_id"] for r in prompts.rejected_replies(parsed).collect()} == {3}


def test_import_intent(spark):
    url = "portal.by/tenders/all/view/"
    cases = {
        "https://www.portal.by/tenders/all/view/77": True, "как подать на тендер 1234567": False, "тендер 1234567": True,
        "1234567": True, "Начинаем подготовку №1234567": True, "привет": False,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "c string")
    got = {r["c"]: r["r"] for r in rows.select("c", mx.should_import(F.col("c"), url).alias("r")).collect()}
    assert got == cases


def test_stems_are_held_by_every_match(spark):
    """Lists of patterns are tried only where a stem stands, so each of their patterns needs one."""
    import re

    from pyspark.sql import functions as F

    from docsluice.operators import policy

    lists = [
        (policy.COMPOSITION, policy.COMPOSITION_STEMS), (policy.MANDATORY_CONTENTS, policy.COMPOSITION_STEMS),
        (policy.PRICING_ANNEX, policy.ANNEX_STEMS), (policy.BANK_SECURITY, policy.BANK_STEMS),
    ]
    for pairs, stems in lists:
        for first, second in pairs:
            assert re.search(stems, first) or (second and all(re.search(stems, x) for x in second.split("|"))), (first, second)
    plan = spark.createDataFrame([("",)], "s string").select(policy.concrete_payment(F.col("s")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("btrim(") == 1  # the trimmed line is one value, not one for each pattern
    lines = ["Предложение ДОЛЖНО содержать условия оплаты 30 %", "К подаче: суть, оплата 30 %", "ОБЕСПЕЧЕНИЕ заявки: банковская гарантия 30 %",
             "Калькуляция услуг, аванс", "Оплата: аванс 30 %", " оплата: аванс "]
    out = spark.createDataFrame([(x,) for x in lines], "s string").select(policy.concrete_payment(F.col("s"))).collect()
    assert [r[0] for r in out] == [False, False, False, False, True, True]
