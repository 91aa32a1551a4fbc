"""Card snapshots: procurement pages → labelled fields, structured card, events, contacts, links and title.

Everything about a page comes from that page, so the job is one narrow stage without a shuffle.
"""

from __future__ import annotations

from functools import reduce
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions import html as hx
from docsluice.functions import text as tx
from docsluice.functions import urls
from docsluice.functions.patterns import extract, extract_all, matches, matches_any, rx


@dataclass(frozen=True)
class Site:
    """The portal whose cards are read and the registry it links to, by host."""

    portal: str
    registry: str = "registry.invalid"

    @property
    def portal_rx(self) -> str:
        return self.portal.replace(".", r"\.")


# Patterns, field labels and limits of the cards.
# Each mark of a page's footer comes with a literal part of it, in upper case.
CHROME_MARKS = [
    (r"©", "©"),
    (r"Республиканск(?:ое|ий)\s+унитарное\s+предприятие", "РЕСПУБЛИКАНСК"),
    (r"Национальн\w+\s+центр\s+поддержки\s+экспорт", "НАЦИОНАЛЬН"),
    (r"\b2013\s*[-–]\s*2026\b", "2013"),
    (r"\/\/\s*-->", "-->"),
    (r"<!\[endif\]", "<!["),
]
FOOTER_NOISE = (
    r"©|Республиканское\s+унитарное|Национальн\w+\s+центр\s+поддержки\s+экспорт|2013\s*[-–]\s*2026|\/\/\s*-->|\[endif\]"
)
EVENT_CUTS = ["©", "//-->", "Республиканское унитарное", "Национальный центр поддержки"]
UI_TITLES = [
    r"^просмотр\s+(конкурса|закупки|аукциона|торгов|тендера|процедуры)\s*\.?\s*$",
    r"^просмотр\s+(конкурса|закупки|аукциона)\s+[←‹»]",
    r"^карточк\w*\s+(закупки|конкурса|торгов|процедуры)\b",
    r"^(конкурс|аукцион|торги|закупк\w+)\s*$",
]
TITLE_FIELDS = [
    ("наименование", "закупк"),
    ("полное", "наименование", "закупк"),
    ("предмет", "закупк"),
    ("наименование", "лот"),
    ("предмет", "лот"),
    ("предмет", "закупки"),
    ("краткое описание предмета закупки",),
    ("наименование", "процедур"),
    ("название", "закупк"),
]
PHONES = [
    r"\+375\s*\d{2}\s*\d{3}\s*\d{2}\s*\d{2}\b",
    r"\+375[\s\-]?\d{2}[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}\b",
    r"80[\s\-]?(?:\d[\s\-]?){9}\d",
    r"\+7[\s\-]?(?:\d[\s\-]?){10}\d",
    r"8\s?\(\d{3,4}\)\s?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}",
]
EMAIL = r"[a-z0-9._%+-]+@[a-z0-9][a-z0-9.-]+\.[a-z]{2,}"
PROCEDURE_REF = r"\bПроцедура\s+закупки\s*№\s*([0-9\-–]+)"
PROCEDURE_FORM = (
    r"\b((?:Запрос\s+ценовых\s+предложений|Электронн(?:ый|ого)\s+аукцион|Открыт(?:ый|ого)\s+конкурс|"
    r"Закрыт(?:ый|ого)\s+конкурс|Запрос\s+котировок))[^\n.]*"
)
PRICE_WORDS = (
    r"(?:начальн[аыеоя]+\s+цен|стартов\w*\s+цен|цен\w*\s+лот|нмц|начальн\w*\s+максимальн|максимальн\w*\s+цен|бюджет|"
    r"ориентировочн\w*\s+стоимость|стоимость\s+закупки|цен[аы]\s+конкурсн|\d[\d\s,.]*\s*(?:BYN|руб\.?|Br|бел\.\s*р))"
)
LABEL_LINE = (
    r"(?:^|[\n\r]|\.\s)(Названи[ея]|Наименовани[ея]|Предмет\s+(?:закупки|лота)|Заказчик|Организатор|"
    r"Контакт(?:ное)?\s*(?:лицо|телефон)?|Срок\s+(?:подачи|окончания)|Дата\s+(?:окончания|подачи))[\s:]+([^\n\r.]{4,240})"
)
DOC_REFERENCE = [
    r"согласно\s+документаци",
    r"согласно\s+услови",
    r"согласно\s+информаци",
    r"\bсм\.\s*прикрепл",
    r"\bсм\.\s*прилож",
    r"в\s+приложенн",
    r"в\s+присоедин",
    r"указано\s+в\s+извещен",
    r"указан\w*\s+в\s+документаци",
    r"находится\s+в\s+конкурсн",
    r"смотр(?:ите)?\s+в\s+(?:прикладн|прилож|файл)",
    r"в\s+соответствии\s+с\s+положением",
    r"\b(?:ред\.|ред\s)\s+по\s+данным",
]
CARD_FIELDS = {
    "general": {"industry": [("отрасль",)], "subject": [("краткое описание предмета закупки",)]},
    "procedure": {
        "invitation_published_at": [("дата размещения приглашения",)],
        "bids_deadline_at": [("окончания приема предложений",), ("приема предложений", "время")],
        "estimated_total_value": [("общая ориентировочная стоимость",), ("ориентировочная стоимость закупки",)],
        "participant_requirements": [("требования к составу участников",)],
        "qualification_requirements": [("квалификационные требования",)],
        "other_info": [("иные сведения",)],
    },
    "competitive_documents": {
        "provision_terms": [("сроки", "место", "порядок предоставления конкурсных документов")],
        "document_price": [("цена конкурсных документов",)],
    },
    "bids": {"submission_place": [("место и порядок представления конкурсных предложений",)]},
    "lot_details": {
        "delivery_period": [("срок поставки",)],
        "delivery_place": [("место поставки товара", "выполнения работ")],
        "funding_source": [("источник финансирования",)],
        "bid_security": [("размер конкурсного обеспечения",)],
        "okrb_code": [("код окрб",)],
    },
}
EVENT_MARKS = [
    r"События\s+в\s+хронологическом\s+порядке", r"События\s+в\s+хронологическом", r"Хронологи\w+\s+событий",
]
CANCEL_WORDS = r"отмен|аннулир|прекращ|недейств|отклон\s*ени"
CHANGE_WORDS = r"изменен|изменён|корректиров|дополнен"
DOCS_HEADER = r"Аукционные\s+документы"
DOCS_END = r"События\s+в\s+хронологическом|конкурсн(?:ые|ыя)\s+документы|закупк(?:и|а)\s*:\s*документы"
WARN_SHORT = "HTML карточки слишком короткий — возможно обрезка или ответ не полной страницы."
WARN_NO_EVENTS = "Блок хронологии событий не найден — проверьте вручную на площадке."
WARN_TITLE = (
    "Заголовок закупки в снимке может быть неточным (на странице только шаблонный заголовок) — "
    "смотрите поля таблицы или карточку."
)
WARN_NO_FIELDS = (
    "Таблица «подпись — значение» не распознана в HTML (возможны div-сетка / подгрузка полей только в браузере). "
    "Основной текст карточки всё равно может быть в комплекте PDF/DOC."
)


def truncate_site_chrome(c: Column, site: Site | None = None) -> Column:
    """Cut at the earliest footer mark whose first occurrence is not near the beginning."""
    marks = CHROME_MARKS + ([(rf"\b{site.portal_rx}\s*[-–]?\s*поддержк", "ПОДДЕРЖК")] if site else [])

    def cut(both: Column) -> Column:
        """A mark is searched only in texts that hold its literal part."""
        text = both["text"]
        first = lambda mark, part: F.when(both["upper"].contains(part), F.regexp_instr(text, F.lit(rx(mark))))
        end = F.array_min(F.filter(F.array(*[first(*m) for m in marks]), lambda p: p > 80))
        return F.rtrim(F.when(end.isNull(), text).otherwise(F.substring(text, F.lit(1), end - 1)))

    return tx.let(c, lambda text: tx.let(F.struct(text.alias("text"), F.upper(text).alias("upper")), cut))


def is_generic_title(t: Column, site: Site) -> Column:
    name = site.portal_rx.split(r"\.")[0]
    return (F.length(t) < 4) | matches_any(
        tx.js_trim(t), [rf"^{site.portal_rx}", rf"^{name}\s*[-–]", rf"\b{site.portal_rx}\s*[-–]\s*\d{{4}}\s*[-–]\s*\d+$"]
    )


def is_ui_title(t: Column, site: Site) -> Column:
    """A heading of the portal itself, not the name of a procurement."""
    return (F.length(t) < 3) | is_generic_title(t, site) | matches_any(tx.js_trim(t), UI_TITLES)


def table_rows(html: Column) -> Column:
    """Array of rows, each an array of cell texts."""
    rows = hx.fragments(html, r"<tr\b[^>]*>([\s\S]*?)</tr>")
    return F.transform(rows, lambda r: F.transform(hx.fragments(r, r"<t[dh]\b[^>]*>([\s\S]*?)</t[dh]>"), hx.strip_cell))


def _table_fields(html: Column) -> Column:
    def named(cells: Column) -> Column:
        """Cells hold no runs of blanks, so neither does a value joined from those with text."""
        key = F.when(cells[0].contains(":"), tx.js_trim(F.regexp_replace(cells[0], r":\s*$", ""))).otherwise(cells[0])
        value = F.array_join(F.filter(F.slice(cells, F.lit(2), F.size(cells)), lambda c: c != ""), " ")
        return F.struct(key.alias("key"), value.alias("value"), cells[1].alias("next"))

    def fits(f: Column) -> Column:
        key = f["key"]
        header = key.startswith("№") & matches(key, r"^№\s*лота$") & matches(f["next"], r"^предмет\s+закупки$")
        lots = matches(key, r"^лоты|раскрыть\s+все\s+лоты|свернуть\s+все\s+лоты$")
        return (F.length(key) >= 2) & (F.length(f["value"]) >= 1) & ~header & ~lots

    rows = F.filter(table_rows(html), lambda cells: F.size(cells) >= 2)
    return F.transform(
        F.filter(F.transform(rows, named), fits), lambda f: F.struct(f["key"].alias("key"), f["value"].alias("value"))
    )


def _hint_fields(html: Column, plain: Column) -> Column:
    part = lambda line, n: tx.collapse_ws(F.regexp_extract(line, rx(LABEL_LINE), n))
    lines = F.transform(extract_all(plain, LABEL_LINE), lambda line: F.struct(part(line, 1).alias("key"), part(line, 2).alias("value")))
    return F.concat(F.filter(lines, lambda f: (F.length(f["key"]) >= 3) & (f["value"] != "")), dl_pairs(html))


def dl_pairs(html: Column) -> Column:
    """Array of (key, value) of dt/dd pairs."""
    pattern = r"<dt[^>]*>([\s\S]*?)</dt>\s*<dd[^>]*>([\s\S]*?)</dd>"
    part = lambda pair, n: hx.strip_html(F.regexp_extract(pair, "(?i)" + pattern, n))
    pairs = F.transform(hx.fragments(html, pattern, 0), lambda pair: F.struct(part(pair, 1).alias("key"), part(pair, 2).alias("value")))
    return F.filter(pairs, lambda f: (F.length(f["key"]) >= 2) & (f["value"] != ""))


def _keys(fields: Column) -> Column:
    return F.array_distinct(F.transform(fields, lambda f: f["key"]))


def _first_values(fields: Column) -> Column:
    """Fields with distinct keys in order of first sight, the first value of each."""
    return F.transform(_keys(fields), lambda k: F.filter(fields, lambda f: f["key"] == k)[0])


def _longest_values(fields: Column) -> Column:
    """Fields with distinct keys in order of first sight, the first of the longest values of each."""

    def best(same: Column) -> Column:
        top = F.array_max(F.transform(same, lambda f: F.length(f["value"])))
        return F.filter(same, lambda f: F.length(f["value"]) == top)[0]

    return F.transform(_keys(fields), lambda k: tx.let(F.filter(fields, lambda f: f["key"] == k), best))


def labelled_fields(html: Column, plain: Column) -> Column:
    """Ordered array of (key, value): labels in the text and dt/dd pairs, then table rows, which override them."""

    def read(page: Column) -> Column:
        hints = tx.let(_hint_fields(page["html"], page["plain"]), _first_values)
        table = tx.let(_table_fields(page["html"]), _longest_values)
        return tx.let(F.struct(hints.alias("h"), table.alias("t")), _override)

    return tx.let(F.struct(html.alias("html"), plain.alias("plain")), read)


def _override(both: Column) -> Column:
    hints, table = both["h"], both["t"]
    merged = F.transform(
        hints, lambda h: F.coalesce(F.try_element_at(F.filter(table, lambda f: f["key"] == h["key"]), F.lit(1)), h)
    )
    new = F.filter(table, lambda f: ~F.exists(hints, lambda h: h["key"] == f["key"]))
    return F.concat(merged, new)


def pick_field(fields: Column, *parts: str) -> Column:
    """Value of the first field whose key holds all parts; NULL if it is blank."""
    return _pick(_lowered(fields), *parts)


def _lowered(fields: Column) -> Column:
    return F.transform(fields, lambda f: F.struct(F.lower(f["key"]).alias("key"), f["value"].alias("value")))


def _pick(lowered: Column, *parts: str) -> Column:
    """``pick_field`` of fields whose keys are in lower case already."""
    def holds(f: Column) -> Column:
        return reduce(lambda a, b: a & b, [f["key"].contains(p.lower()) for p in parts])

    found = F.try_element_at(F.filter(lowered, holds), F.lit(1))
    return F.nullif(tx.js_trim(found["value"]), F.lit(""))


def is_doc_reference(c: Column) -> Column:
    """The value points to the documentation instead of naming somebody."""
    t = tx.js_trim(F.coalesce(c, F.lit("")))
    return (F.length(t) < 6) | matches_any(F.lower(t), DOC_REFERENCE)


def customer_priority(key: Column) -> Column:
    """Rank of a label as the customer's name: 0 is best, 999 is none."""
    return tx.let(F.lower(tx.js_trim(key)), _customer_rank)


def _customer_rank(kl: Column) -> Column:
    def has(p: str) -> Column:
        return matches(kl, p)

    contact = has(r"фамил|телефон|e-mail|email|факс|контактн\w*\s+лиц\w*(?!\s+заказчик)")
    named = has(r"наименование|организатор|инициатор|заказчик")
    name = has(r"наименование") & ~has(r"сокращ")
    # Every rank needs one of these words, so most labels are settled by one search.
    relevant = has(r"заказчик|инициатор|организатор|закупка\s+(?:проводится|осуществля)")
    return (
        F.when(~relevant, 999)
        .when((kl == "") | (F.length(kl) > 260) | (contact & ~named), 999)
        .when(has(r"полное\s+наименование") & has(r"заказчик|инициатор|организатор"), 0)
        .when(name & has(r"заказчик|инициатор"), 1)
        .when(has(r"организатор\s+закупк|организатор\s+конкурсн"), 2)
        .when(has(r"закупка\s+(?:проводится|осуществля)"), 3)
        .when(has(r"сокращ.+наименование") & has(r"заказчик"), 4)
        .when(has(r"^(?:заказчик|инициатор|организатор)[\s:]*$"), 6)
        .when(has(r"\bзаказчик\b"), 7)
        .when(has(r"\bорганизатор\b"), 8)
        .when(has(r"\bинициатор\b"), 9)
        .otherwise(999)
    )


def ranked_pick(fields: Column, priority=customer_priority) -> Column:
    """Value with the best label, then the longest, then the first; references to the documentation do not count."""
    ranked = F.transform(
        fields,
        lambda f, i: F.struct(
            priority(f["key"]).alias("p"), (-F.length(tx.js_trim(f["value"]))).alias("l"), i.alias("i"),
            tx.js_trim(f["value"]).alias("v"),
        ),
    )
    fit = F.filter(ranked, lambda r: (r["p"] < 999) & ~is_doc_reference(r["v"]))
    return F.array_min(fit)["v"]


def structured_card(fields: Column) -> Column:
    """Canonical struct of the card's fields.

    Keys are put in lower case once for all labels, and once into one text: a label is looked for in the fields only if
    that text holds it, which most cards do for few labels.
    """
    return tx.let(_lowered(fields), lambda low: tx.let(F.struct(low.alias("f"), F.array_join(F.transform(low, lambda f: f["key"]), "\n").alias("k")), _structured))


def _structured(both: Column) -> Column:
    fields, keys = both["f"], both["k"]

    def pick(*parts: str) -> Column:
        return F.when(reduce(lambda a, b: a & b, [keys.contains(p.lower()) for p in parts]), _pick(fields, *parts))

    def first(options: list[tuple[str, ...]]) -> Column:
        return F.coalesce(*[pick(*parts) for parts in options])

    groups = {
        group: F.struct(*[first(options).alias(leaf) for leaf, options in leaves.items()])
        for group, leaves in CARD_FIELDS.items()
    }
    conducted = pick("закупка проводится")
    full = pick("полное наименование заказчика")
    groups["customer"] = F.struct(
        F.when(~is_doc_reference(conducted), conducted).alias("conducted_by"),
        F.coalesce(ranked_pick(fields), F.when(~is_doc_reference(full), full)).alias("name_address"),
        pick("фамилии", "телефон").alias("contacts"),
    )
    order = ("general", "customer", "procedure", "competitive_documents", "bids", "lot_details")
    return F.struct(*[groups[g].alias(g) for g in order])


def phones(c: Column) -> Column:
    """Distinct phone numbers of at least eight characters, pattern by pattern."""
    found = F.flatten(F.array(*[extract_all(c, p) for p in PHONES]))
    return F.filter(F.array_distinct(F.transform(found, tx.collapse_ws)), lambda p: F.length(p) >= 8)


def emails(c: Column) -> Column:
    """Distinct lower-case addresses without trailing punctuation; most texts hold no @ and are not searched."""
    hits = F.when(c.contains("@"), F.regexp_extract_all(c, F.lit("(?i)" + EMAIL), F.lit(0)))
    found = F.transform(F.coalesce(hits, F.array().cast("array<string>")), lambda e: F.regexp_replace(F.lower(e), r"[.,;]+$", ""))
    return F.filter(F.array_distinct(found), lambda e: F.length(e) > 5)


def procedure_ref_form(c: Column) -> Column:
    ref = F.regexp_replace(extract(c, PROCEDURE_REF), r"[–-]+", "-")
    return F.struct(F.trim(ref).alias("reference"), tx.js_trim(extract(c, PROCEDURE_FORM)).alias("form"))


def price_hints(plain: Column, words: str = PRICE_WORDS) -> Column:
    """Distinct windows of 40 characters before and 220 after the start of each price word.

    Positions are found by walking from hit to hit, so overlapping windows come out whole.
    """
    return _windows(plain, extract_all(plain, words))


def _windows(plain: Column, hits: Column) -> Column:
    seed = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, hit: Column) -> Column:
        at = F.position(hit, plain, acc["next"])
        return F.struct((at + F.length(hit)).alias("next"), F.concat(acc["at"], F.array(at)).alias("at"))

    at = F.aggregate(hits, seed, step, lambda acc: acc["at"])

    def window(p: Column) -> Column:
        start = F.greatest(p - 40, F.lit(1))
        return tx.collapse_ws(F.substring(plain, start, p + 220 - start))

    return F.array_distinct(F.filter(F.transform(at, window), lambda w: w != ""))


def chronology_events(plain_lines: Column, html: Column, site: Site | None = None) -> Column:
    """Array of (date, text, severity) of the section of events; empty without one."""
    none = F.array().cast("array<struct<date:string,text:string,severity:string>>")

    def start(cut: Column) -> Column:
        places = [F.nullif(F.regexp_instr(cut, F.lit(rx(m))), F.lit(0)) for m in EVENT_MARKS]

        def by_table(at: Column) -> Column:
            before = F.length(hx.strip_html(F.substring(html, F.lit(1), at - 1))) + 1
            return F.when(at > 0, F.least(before, F.greatest(F.length(cut), F.lit(1))))

        table = tx.let(F.regexp_instr(html, F.lit(r'(?i)<table[^>]+class="[^"]*chronolog[^"]*"')), by_table)
        return F.coalesce(*places, table)

    def events(section: Column) -> Column:
        chunks = F.split(section, r"(?=\d{2}\.\d{2}\.\d{4}(?!\d))")
        found = F.transform(chunks, lambda c, i: tx.let(tx.collapse_ws(c), lambda chunk: _event(chunk, i)))
        return F.filter(found, lambda e: e.isNotNull())

    def read(cut: Column) -> Column:
        def from_(at: Column) -> Column:
            section = truncate_site_chrome(F.substring(cut, at, F.length(cut)), site)
            return F.when(at.isNotNull(), events(section)).otherwise(none)

        return tx.let(start(cut), from_)

    return tx.let(truncate_site_chrome(plain_lines, site), read)


def _clean_event(c: Column) -> Column:
    out = F.regexp_replace(tx.collapse_ws(c), r"^\s*:\d{1,3}\s+", "")
    for needle in EVENT_CUTS:
        out = tx.let(out, _cut_before(needle))
    return tx.collapse_ws(out)


def _cut_before(needle: str):
    return lambda t: F.when(F.instr(t, needle) > 9, F.trim(F.substring_index(t, needle, 1))).otherwise(t)


def _event(chunk: Column, i: Column) -> Column:
    head = r"^(\d{2}\.\d{2}\.\d{4})(?:\s+(\d{1,2}:\d{2}(?::\d{2})?))?\s*[—\-–]?\s*(.+)$"
    date, time = F.regexp_extract(chunk, head, 1), F.regexp_extract(chunk, head, 2)

    def dated(text: Column) -> Column:
        severity = F.when(matches(text, CANCEL_WORDS), "cancel").when(matches(text, CHANGE_WORDS), "change").otherwise("info")
        at = tx.let(time, lambda t: F.when(t != "", F.concat_ws(" ", date, t)).otherwise(date))
        event = F.struct(at.alias("date"), text.alias("text"), severity.alias("severity"))
        return F.when((F.length(text) >= 12) & ~matches(text, FOOTER_NOISE, ignore_case=False), event)

    def free(text: Column) -> Column:
        event = F.struct(F.lit(None).cast("string").alias("date"), text.alias("text"), F.lit("info").alias("severity"))
        return F.when((F.length(text) >= 20) & ~matches(text, FOOTER_NOISE, ignore_case=False), event)

    # Only the piece before the first date can lack one.
    return F.when(F.length(chunk) < 15, None).when(date != "", tx.let(_clean_event(F.regexp_extract(chunk, head, 3)), dated)).when(
        (i == 0) & (F.length(chunk) > 40), tx.let(_clean_event(chunk), free)
    )


def document_links(html: Column, base: Column) -> Column:
    """Distinct (name, href) of anchors whose address or text has a document extension."""
    texts = F.transform(
        hx.anchors(html), lambda a: F.struct(a["href"].alias("href"), hx.strip_html(a["inner"]).alias("inner"))
    )

    def fits(a: Column) -> Column:
        by_href = a["href"].rlike(r"(?i)\.(pdf|docx?|zip|rar|7z)(\?|[#&]|$)")
        return (a["href"] != "") & (by_href | a["inner"].rlike(r"(?i)\.(pdf|docx?)(\?|[#&]|$)"))

    def link(a: Column) -> Column:
        last = F.nullif(F.regexp_extract(a["href"], r"([^/]*)$", 1), F.lit(""))
        name = F.coalesce(F.nullif(a["inner"], F.lit("")), last, a["href"])
        return F.struct(name.alias("name"), F.coalesce(urls.resolve_url(base, a["href"]), a["href"]).alias("href"))

    return tx.let(F.transform(F.filter(texts, fits), link), _first_per_href)


def _first_per_href(links: Column) -> Column:
    hrefs = F.array_distinct(F.transform(links, lambda x: x["href"]))
    return F.transform(hrefs, lambda h: F.filter(links, lambda x: x["href"] == h)[0])


def json_ld_name(html: Column, site: Site) -> Column:
    """First name of more than 15 characters in the page's JSON-LD; '' if there is none."""
    blocks = hx.fragments(html, r"<script[^>]+type\s*=\s*[\"']application/ld\+json[\"'][^>]*>([\s\S]*?)</script>")

    def names(raw: Column) -> Column:
        doc = F.try_parse_json(raw)
        items = F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), F.array(doc))
        values = F.transform(items, lambda x: F.try_variant_get(x, "$.name", "variant"))
        texts = F.filter(values, lambda v: v.isNotNull() & (F.schema_of_variant(v) == "STRING"))
        return F.transform(texts, lambda v: F.try_variant_get(v, "$", "string"))

    good = F.filter(F.flatten(F.transform(blocks, names)), lambda n: (F.length(n) > 15) & ~is_ui_title(n, site))
    return F.coalesce(tx.js_trim(F.try_element_at(good, F.lit(1))), F.lit(""))


def first_h1(html: Column, site: Site) -> Column:
    found = F.transform(hx.fragments(html, r"<h1[^>]*>([\s\S]*?)</h1>"), hx.strip_html)
    good = F.filter(found, lambda t: (F.length(t) >= 12) & ~is_ui_title(t, site))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))


def procurement_title(fields: Column, site: Site) -> Column:
    """Name of the procurement from its labelled fields, NULL if none is usable."""

    def usable(c: Column) -> Column:
        return F.when((F.length(c) >= 4) & ~is_ui_title(c, site) & ~matches(c, FOOTER_NOISE, ignore_case=False), c)

    def first(lowered: Column) -> Column:
        """Labels are tried in order and only up to the first that is usable."""
        return F.coalesce(*[tx.let(_pick(lowered, *parts), usable) for parts in TITLE_FIELDS])

    return tx.let(_lowered(fields), first)


def page_title(from_fields: Column, og: Column, tag: Column, ld: Column, h1: Column, heads: Column, site: Site) -> Column:
    """The title waterfall: fields, then og:title or the title tag, then JSON-LD or h1, then headings."""
    filled = lambda c: F.nullif(c, F.lit(""))
    base = F.coalesce(filled(og), filled(tag), F.lit(""))
    second = F.when(is_generic_title(base, site), F.coalesce(filled(ld), filled(h1), base)).otherwise(base)
    about = F.filter(heads, lambda h: matches(h, r"процедур\w*\s+закупк") & ~is_ui_title(h, site))
    good = F.filter(heads, lambda h: ~is_ui_title(h, site) & (F.length(h) >= 15))
    by_heading = F.coalesce(*[F.try_element_at(x, F.lit(1)) for x in (about, good, heads)], second)
    return F.coalesce(from_fields, F.when(is_generic_title(second, site), by_heading).otherwise(second))


def card_snapshot(pages: DataFrame, site: Site, url: str = "url", html: str = "html") -> DataFrame:
    """One snapshot row per page; the columns of the input stay, without the HTML."""
    kept = [c for c in pages.columns if c != html]
    step = pages.select(*kept, F.length(html).alias("_size"), hx.strip_comments(F.coalesce(html, F.lit(""))).alias("_h"))
    step = step.withColumns({"_one": hx.strip_html(F.col("_h")), "_lines": hx.strip_html_lines(F.col("_h"))})
    h, one = F.col("_h"), F.col("_one")
    step = step.withColumns(
        {
            "labelled_fields": labelled_fields(h, truncate_site_chrome(one, site)),
            "headings": hx.headings(h),
            "_og": hx.meta_content(h, "og:title"),
            "_tag": hx.title_tag(h),
            "_h1": first_h1(h, site),
            "_ld": json_ld_name(h, site),
            "events": chronology_events(F.col("_lines"), h, site),
        }
    )
    fields = F.col("labelled_fields")
    step = step.withColumn("_named", procurement_title(fields, site))
    title = page_title(F.col("_named"), *[F.col(c) for c in ("_og", "_tag", "_ld", "_h1", "headings")], site)
    step = step.withColumn("title", F.nullif(title, F.lit("")))
    filled = lambda c: F.nullif(c, F.lit(""))
    warnings = F.array(
        F.when(F.coalesce(F.col("_size"), F.lit(0)) < 500, WARN_SHORT),
        F.when(F.size("events") == 0, WARN_NO_EVENTS),
        F.when(is_ui_title(F.coalesce("title", F.lit("")), site) & F.col("_named").isNull(), WARN_TITLE),
        F.when((F.size(fields) == 0) & (F.length(one) > 3000), WARN_NO_FIELDS),
    )
    return step.select(
        *kept,
        F.lit(2).alias("schema_version"),
        "title",
        procedure_ref_form(one).alias("procedure"),
        F.struct(
            filled("_og").alias("og_title"), filled("_tag").alias("title_tag"), filled("_h1").alias("h1"), filled("_ld").alias("json_ld_name")
        ).alias("title_sources"),
        "headings",
        phones(one).alias("phones"),
        emails(one).alias("emails"),
        price_hints(one).alias("price_hints"),
        "labelled_fields",
        structured_card(fields).alias("structured"),
        document_links(h, F.col(url)).alias("document_links"),
        "events",
        F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"),
    )


def any_cancel_event(events: DataFrame, key: str, severity: str = "severity") -> DataFrame:
    return events.groupBy(key).agg(F.bool_or(F.col(severity) == "cancel").alias("cancelled"))


def document_section(html: Column, header: str = DOCS_HEADER, end: str = DOCS_END) -> Column:
    """The part of a page from its header of documents to the next section; NULL without the header."""
    at = F.regexp_instr(html, F.lit(rx(header)))
    tail = F.substring(html, at, F.length(html))
    skip = F.least(F.lit(200), F.length(tail))
    stop = F.regexp_instr(F.substring(tail, skip + 1, F.length(tail)), F.lit(rx(end))) - 1
    size = F.when(stop > 80, skip + stop).otherwise(F.length(tail))
    return F.when(at > 0, F.substring(tail, F.lit(1), size))


# Labels that lead to a budget, a deadline and a customer, and how a corpus names the customer.
BUDGET_LABELS = r"стоимост|нмц|цен\w*\s+лот|ориентировочн"
DEADLINE_LABELS = r"окончани|подач|прием\w*\s+предложен"
CUSTOMER_LABELS = r"заказчик|организатор"
CUSTOMER_LINES = [
    r"(?:полное\s+)?наименование\s+заказчика\s*[:\s]+([^\n]+)",
    r"заказчик\s*[:\s]+([^\n]+)",
    r"организатор\s+закупк\w*\s*[:\s]+([^\n]+)",
]
NO_CUSTOMER = "[уточнить полное наименование заказчика по извещению]"


def _labelled(fields: Column, labels: str, fit=None) -> Column:
    ok = F.filter(
        fields,
        lambda f: matches(f["key"], labels) & tx.non_blank(f["value"]) & (F.lit(True) if fit is None else fit(f["value"])),
    )
    return tx.js_trim(F.try_element_at(ok, F.lit(1))["value"])


def _filled(c: Column) -> Column:
    return F.nullif(tx.js_trim(c), F.lit(""))


def budget_hint(structured: Column, hints: Column, fields: Column) -> Column:
    """Budget: structured card, else the first price hint, else a matching label."""
    first = _filled(F.try_element_at(hints, F.lit(1)))
    value = F.coalesce(_filled(structured["procedure"]["estimated_total_value"]), first, _labelled(fields, BUDGET_LABELS))
    return value


def deadline_hint(structured: Column, fields: Column) -> Column:
    value = F.coalesce(_filled(structured["procedure"]["bids_deadline_at"]), _labelled(fields, DEADLINE_LABELS))
    return value


def title_hint(title: Column, structured: Column) -> Column:
    """The title if it has six characters, else other information of twelve."""
    t = tx.js_trim(title)
    other = tx.js_trim(structured["procedure"]["other_info"])
    return F.when(F.length(t) >= 6, t).when(F.length(other) >= 12, other)


def customer_line(corpus: Column) -> Column:
    """First line of a corpus that names the customer and does not only point to the documentation."""
    found = [tx.js_trim(extract(corpus, p)) for p in CUSTOMER_LINES]
    return F.coalesce(*[F.when(~is_doc_reference(f), f) for f in found])


def customer_name(structured: Column, fields: Column, corpus: Column) -> Column:
    """Customer: ranked label, structured name, who conducts it, any label, a corpus line, a placeholder."""
    named = lambda c: F.when(~is_doc_reference(c), _filled(c))
    value = F.coalesce(
        ranked_pick(fields),
        named(structured["customer"]["name_address"]),
        named(structured["customer"]["conducted_by"]),
        _labelled(fields, CUSTOMER_LABELS, lambda v: ~is_doc_reference(v)),
        customer_line(corpus),
        F.lit(NO_CUSTOMER),
    )
    return value
