import json

from docsluice.operators import requirements as rq

SAMPLE = {
    "tender_id": "demo", "criteria": [{"raw": "Цена — 40 баллов", "source": {"file": "d.pdf", "page": 3}}],
    "requirements": [
        {"id": "R1", "text": "Опыт 3 года", "source": {"file": "a.pdf", "page": 12}, "confidence": 0.92, "needs_review": False},
        {"id": "R2", "text": "Гарантия 24 месяца", "source": {"page": 15}, "confidence": 0.4, "needs_review": True},
        {"id": "R2", "text": "Повтор", "source": {"fragment": "п. 1"}},
    ],
    "deadlines": [{"id": "D1", "label": "Подача", "datetime": "2026-06-01T18:00:00+03:00", "source": {"file": "b.pdf"}}],
    "meta": {"parser_version": "1", "warnings": ["given"]},
}
BROKEN = {
    "tender_id": " ", "requirements": [None, {"id": 1, "text": "x", "source": {"page": 3}}, []], "deadlines": {},
    "criteria": [{"raw": "a", "source": None}, {"raw": ""}, 5], "meta": {"parser_version": 1, "warnings": ["a", 2]},
}


def docs(spark, *values):
    rows = [(i, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)]
    return rq.parse_documents(spark.createDataFrame(rows, "doc_id int, json string"))


def test_valid_result(spark):
    parsed = docs(spark, SAMPLE, "nope")
    ok = rq.accept_valid(parsed, rq.result_issues)
    assert [r["doc_id"] for r in ok.collect()] == [0]
    rows = rq.requirement_rows(ok)
    warnings = rq.snapshot_warnings(rows, rq.meta_warnings(ok)).orderBy("section", "sort_id", "pos", "line")
    assert [r["warning"] for r in warnings.collect()] == [
        "given", "Дублируется requirement id: R2", "Требование R2 помечено needs_review", "Требование R2: низкая уверенность (0.4)",
    ]
    notes = {(r["requirement_id"], r["notes"]) for r in rq.compliance_matrix(rows).collect()}
    assert notes == {("R1", None), ("R2", rq.REVIEW_NOTE), ("R2", None)}
    assert rq.deadline_rows(ok).first()["datetime_at"] is not None
    assert rq.criterion_rows(ok).first()["source"]["page"] == 3


def test_every_issue_is_listed(spark):
    found = rq.validate(docs(spark, BROKEN), rq.result_issues).orderBy("ord").collect()
    assert [r["path"] for r in found] == [
        "tender_id", "requirements[0]", "requirements[1].id", "requirements[2].id", "requirements[2].text", "requirements[2].source",
        "deadlines", "criteria[0].source", "criteria[1].raw", "criteria[2]", "meta.parser_version", "meta.warnings",
    ]


def test_requests(spark):
    good = {"tender_id": "a", "document_urls": ["u"], "locale": "ru", "options": {"extract_deadlines": True}}
    bad = {"tender_id": "a", "document_urls": ["x", " "], "locale": "", "options": {"foo": 1, "extract_deadlines": "y"}}
    found = rq.validate(docs(spark, good, bad, {**good, "options": None}, {**good, "document_urls": []}), rq.request_issues)
    paths = {}
    for r in found.orderBy("doc_id", "ord").collect():
        paths.setdefault(r["doc_id"], []).append(r["path"])
    assert paths == {1: ["document_urls[1]", "locale", "options.foo", "options.extract_deadlines"], 2: ["options"], 3: ["document_urls"]}
