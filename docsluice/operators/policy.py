"""Price and contract-terms rules over the lines of a corpus.

Every rule looks at one tender's bounded corpus, so the job is a projection: no line is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions import money
from docsluice.functions import text as tx
from docsluice.functions.patterns import extract, extract_all, matches, matches_any

# Patterns, thresholds and words of the rules.
REDUCTION = [
    r"процедур\w*\s+улучшен",
    r"улучшен\w*\s+предложен",
    r"ценов\w*\s+предложен\w*\s+участник",
    r"добровольн\w*\s+снижен",
    r"снижен\w*\s+цен",
    r"цен\w*\s+снижен",
    r"снижен\w*\s+начальн",
    r"снижен\w*\s+ценов\w*\s+предложен",
    r"переговор\w*(\s+и|\s+по|\s+в)?\s*улучшен",
    r"переговор\w*\s+об\s+улучшен",
    r"торг\w*\s+на\s+понижен",
    r"этап\w*\s+снижен",
    r"этап\w*\s+улучшен",
    r"повторн\w*\s+подач\w*\s+ценов",
    r"повторн\w*\s+предложен",
]
REDUCTION_SHORT = (
    r"снижен(?:ие|ия|ию|и)\b|этап\w*\s+снижен|переговор\w*\s+(?:в\s+)?(?:рамках\s+)?(?:процедур\w*\s+)?снижен|"
    r"улучшен\w*\s+(?:предложен|оферт)|торг\w*\s+на\s+понижен|конкурентн\w*\s+переговор|приглашени\w*\s+на\s+снижен|"
    r"запрос\w*\s+об\s+улучшен"
)
NOMINAL_START = (
    r"\b(?:начальн\w+|максимальн\w+|предельн\w+|стартов\w+)\s+[^\n]{0,120}?\b(?:0[,.]1|1)(?![\d.,])(?:\s*(?:руб|byn|бел|₽))?"
)
NOMINAL_PRICE = r"\bцена(?:\s+единицы)?\s+[^\n]{0,60}?\b(?:0[,.]1|1)\s*(?:руб|BYN|бел|₽)"
ANY_AMOUNT = r"(?<![\w.,])(\d+(?:[.,]\d+)?)\s*(?:руб|BYN|бел|рубл|BYR|₽)(?!\w)"
MAX_ABSURD, COORDINATE_BELOW, MIN_CEILING, MIN_SANITY = 5.0, 10_000.0, 50.0, 100.0
PRICE_LINE = (
    r"нмц|начальн\w*(?:\s+максимальн\w*)?\s+цен|предельн\w*\s+цен|ориентировочн\w*\s+стоимост|стоимост\w*\s+закупк|"
    r"цен\w*\s+лот|единицы\s+цен|ценов\w*\s+предложен"
)
CEILING_LINE = PRICE_LINE + r"|стартов\w*\s+цен"
FIRST_MONEY = (
    r"((?:\d{1,3}(?:\s\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)\s*(?:тыс\.?|млн\.?)?\s*"
    r"(?:BYN|бел\.?\s*руб|белорусск\w*\s*руб|руб\.?|₽|RUB))"
)
STATED_PRICE = (
    r"(?:НМЦК|начальн\w*\s+(?:максимальн\w*\s+)?цен\w*|ориентировочн\w*\s+стоимост\w*)[^0-9]{0,40}(\d[\d\s]*(?:[.,]\d+)?)"
)
HINT_NO_CEILING = (
    "• Стартовую / предельную / НМЦ с суммой в тексте не нашла (валюта может быть USD, EUR, BYN, RUB и др.). "
    "Имеет смысл сверить полный комплект документов."
)
HINT_NO_REDUCTION = (
    "• Явных формулировок про снижение цены, улучшение предложения или переговоры по цене в тексте не видно — "
    "если в закупке это есть, ориентируйтесь на полный комплект."
)
HINT_BOTH = (
    "• В тексте есть и ориентир по цене заказчика, и процедура улучшения/снижения — учитывайте при выборе стартовой цены участника."
)
MIN_HINT = 12
SLOTS = ("price", "payment", "delivery", "warranty")
SLOT_PRICE = (
    r"нмц|начальн\w*(?:\s+максимальн\w*)?\s+цен|предельн\w*\s+цен|стартов\w*\s+цен|цен\w*\s+лот|"
    r"ориентировочн\w*\s+стоимост|стоимост\w*\s+закупк|единиц\w*\s+цен"
)
SLOT_PAYMENT = (
    r"оплат|платеж|платёж|аванс|предоплат|отсроч|перечислен|порядок\s+расч[её]тов|условия\s+оплат|"
    r"окончательн\w*\s+расч[её]т|расч[её]ты?\s+(?:производ|осуществл)"
)
SLOT_DELIVERY = (
    r"срок\s+поставк|поставк\w*\s+товар|срок\s+оказан|оказан\w*\s+услуг|календарн\w*\s+дн|рабоч\w*\s+дн|"
    r"в\s+течение\s+\d+|не\s+более\s+\d+\s+дн"
)
SLOT_WARRANTY = r"гарантийн|гарантия|срок\s+гарант"
PAYMENT_CONCRETE = [
    r"\d{1,3}\s*%|\d+\s*/\s*\d+|половин\w*\s+сумм|треть\s+сумм",
    r"\d+\s*(?:рабоч|календарн)\w*\s*дн",
    r"\d+\s*дн\w*\s+после",
    r"аванс|предоплат|постоплат|отсроч\w*\s+платеж|рассрочк|аккредитив",
    r"после\s+(?:утвержден|подписан|согласован)\w*\s+акт",
    r"до\s+отгрузк|при\s+отгрузк|перед\s+отгрузк|после\s+поставк",
]
WARRANTY_CONCRETE = [
    r"\d+\s*(?:мес|месяц|лет|года?|г\.|календарн|рабоч)\w*",
    r"не\s+менее\s+\d+",
    r"гарантия\s+(?:на\s+)?(?:узел|изделие|оборудован|работ|услуг|результат)",
]
WARRANTY_TERM = r"срок\s+гарант|гарантийн\w*\s+(?:срок|период)"
# Pairs: both must occur in the line for the exclusion to hold.
COMPOSITION = [
    (r"предложен\w*\s+должн\w*\s+содержать", ""),
    (
        r"должн\w*\s+содержать",
        r"коммерческ|технико-\s*коммерческ|цен|стоимост|платеж|оплат|гарантийн\w*\s+обязательств",
    ),
    (r"к\s+подаче", r"суть"),
    (r"требован\w*\s+к\s+составу", ""),
    (r"должн\w*\s+включать", r"коммерческ\w*\s+предложен"),
]
MANDATORY_CONTENTS = [
    (r"должн\w*\s+содержать", r"платеж|оплат"),
    (r"должн\w*\s+содержать", r"условия\s+и\s+сроки"),
    (r"требован\w*\s+к\s+составу", r"оплат|платеж|расч[её]т"),
    (r"состав\w*\s+(?:заявк|предложен)", r"порядок\s+платеж"),
]
PRICING_ANNEX = [
    (r"расч[её]т\s+стоимости", ""),
    (r"стоимости\s+услуг\s+с\s+включением", ""),
    (r"включени\w*\s+всех\s+расходов", ""),
    (r"калькуляц", r"(?:услуг|работ|товар)"),
    (r"требован\w*\s+к\s+оформлен\w*\s+коммерческ", ""),
    (r"пункт\s+\d+\s+перечня\s+документ", ""),
    (r"перечн\w*\s+документов", r"коммерческ\w*\s+предложен"),
]
BANK_SECURITY = [
    (r"банковск\w*\s+гарант", ""),
    (r"гарантия\s+на\s+возврат\s+аванс", ""),
    (r"обязательств\w*\s+предоставить\s+банковск", ""),
    (r"обеспечени\w*\s+(?:заявк|участник|исполнен|контракт)", r"банковск|гарант"),
    (r"возврат\s+авансов", r"банковск|гарант"),
]
# What every match of these lists holds: a line without it meets none of their patterns.
COMPOSITION_STEMS = r"содержать|подаче|состав|включать"
ANNEX_STEMS = r"стоимости|включени|калькуляц|требован|пункт|перечн"
BANK_STEMS = r"банковск|гарант"
FROM_DOCUMENTS = "По документам закупки (автовыдержка из текста Analysis; проверьте по полному комплекту):"
MODES = ("reduction_docs_ok", "reduction_fake_price", "no_reduction")


def mentions_price_reduction(c: Column, patterns: list[str] = REDUCTION, dialect: str = "intended") -> Column:
    return matches_any(c, patterns, dialect)


def mentions_reduction_short(c: Column, dialect: str = "intended") -> Column:
    return matches(c, REDUCTION_SHORT, dialect)


def absurd_price(c: Column, max_absurd: float = MAX_ABSURD, dialect: str = "intended") -> Column:
    """A nominal start price, a price of one, or any positive amount up to the limit."""
    small = F.exists(
        extract_all(c, ANY_AMOUNT, 1, dialect), lambda a: (money.to_number(a) > 0) & (money.to_number(a) <= max_absurd)
    )
    return F.coalesce(matches_any(c, [NOMINAL_START, NOMINAL_PRICE], dialect) | small, F.lit(False))


def _price_lines(c: Column, words: str, dialect: str) -> Column:
    return F.filter(F.split(c, "\n"), lambda line: matches(line, words, dialect))


def price_below_threshold(c: Column, below: float = COORDINATE_BELOW, dialect: str = "intended") -> Column:
    """A price line whose first amount in roubles is positive and below the threshold."""
    amounts = F.transform(_price_lines(c, PRICE_LINE, dialect), lambda line: money.byn_amount(line, dialect))
    return F.coalesce(F.exists(amounts, lambda n: F.coalesce((n > 0) & (n < below), F.lit(False))), F.lit(False))


def has_price_ceiling(c: Column, least: float = MIN_CEILING, dialect: str = "intended") -> Column:
    """A price line with an amount, in any currency, that is no mere placeholder."""
    amounts = F.transform(_price_lines(c, CEILING_LINE, dialect), lambda line: money.line_amount(line, dialect))
    return F.coalesce(F.exists(amounts, lambda n: F.coalesce(n >= least, F.lit(False))), F.lit(False))


def price_coordination(rows: DataFrame, corpus: str = "corpus", dialect: str = "intended") -> DataFrame:
    """Add the price flags and ``manager_hints``."""
    c = F.col(corpus)
    flagged = rows.withColumns(
        {
            "has_reduction": mentions_price_reduction(c, dialect=dialect),
            "absurd": absurd_price(c, dialect=dialect),
            "below_threshold": price_below_threshold(c, dialect=dialect),
            "has_ceiling": has_price_ceiling(c, dialect=dialect),
        }
    )
    ceiling, reduction = F.col("has_ceiling"), F.col("has_reduction")
    hints = F.array(
        F.when(~ceiling, HINT_NO_CEILING), F.when(~reduction, HINT_NO_REDUCTION), F.when(ceiling & reduction, HINT_BOTH)
    )
    return flagged.withColumns(
        {
            "no_procedure": ~reduction,
            "needs_coordination": F.col("absurd") | F.col("below_threshold") | ~reduction,
            "manager_hints": F.filter(hints, lambda h: h.isNotNull()),
        }
    )


def is_suspicious_price(price: Column) -> Column:
    return F.coalesce((price > 0) & (price < MIN_SANITY), F.lit(False))


def _usable_price(raw: Column) -> Column:
    """Struct of a text and its positive amount; NULL where it has none."""
    return tx.let(raw, lambda r: tx.let(money.parse_money(r), lambda v: F.when(v > 0, F.struct(r.alias("raw"), v.alias("value")))))


def price_analysis(rows: DataFrame, corpus: str = "corpus", estimate: str = "estimate", other_info: str | None = None) -> DataFrame:
    """Add the customer's reference price, whether it is suspicious, and the pricing mode.

    The price comes from the structured card, else from the first amount in the text, else from a stated price.
    """
    blob = F.coalesce(corpus, F.lit(""))
    searched = F.concat_ws("\n", corpus, *([other_info] if other_info else []))
    # Each in its turn: a text is searched only where what stands before it gives no price, and parsed once.
    options = F.nullif(tx.js_trim(F.col(estimate)), F.lit("")), tx.js_trim(extract(blob, FIRST_MONEY)), tx.js_trim(extract(blob, STATED_PRICE))
    priced = rows.withColumns({"has_reduction": mentions_reduction_short(searched), "_price": F.coalesce(*map(_usable_price, options))})
    out = priced.withColumns({"reference_price": F.col("_price.value"), "reference_raw": F.col("_price.raw")})
    out = out.withColumn("suspicious", is_suspicious_price(F.col("reference_price")))
    mode = F.when(F.col("has_reduction") & ~F.col("suspicious"), "starting_offer_allowed").otherwise("manager_price_required")
    return out.withColumn("pricing_mode", mode).drop("_price")


def clean_hint_line(c: Column) -> Column:
    return tx.collapse_ws(F.regexp_replace(c, r"^[\s\p{Z}>*\-•]+", ""))


def _any_pair(line: Column, pairs: list[tuple[str, str]], stems: str) -> Column:
    out = F.lit(False)
    for first, second in pairs:
        out = out | (matches(line, first) & (matches(line, second) if second else F.lit(True)))
    return matches(line, stems) & out


def proposal_composition(line: Column) -> Column:
    """What a proposal must contain, not what the customer offers."""
    return _any_pair(line, COMPOSITION, COMPOSITION_STEMS)


def mandatory_contents(line: Column) -> Column:
    both = matches(line, COMPOSITION_STEMS) & matches(line, r"должн\w*\s+включать") & matches(line, r"коммерческ\w*\s+предложен") & matches(line, r"оплат|платеж")
    return _any_pair(line, MANDATORY_CONTENTS, COMPOSITION_STEMS) | both


def pricing_annex(line: Column) -> Column:
    return _any_pair(line, PRICING_ANNEX, ANNEX_STEMS)


def bank_security(line: Column) -> Column:
    return _any_pair(line, BANK_SECURITY, BANK_STEMS)


def concrete_payment(line: Column) -> Column:
    """The line states shares, dates or forms of payment."""

    def tested(s: Column) -> Column:
        out = proposal_composition(s) | mandatory_contents(s) | pricing_annex(s) | bank_security(s)
        held = matches(s, f"{COMPOSITION_STEMS}|{ANNEX_STEMS}|{BANK_STEMS}")
        return (F.length(s) >= MIN_HINT) & matches_any(s, PAYMENT_CONCRETE) & ~(held & out)

    return tx.let(tx.js_trim(line), tested)


def concrete_warranty(line: Column) -> Column:
    """The line states how long or for what a warranty lasts."""

    def tested(s: Column) -> Column:
        term = matches_any(s, WARRANTY_CONCRETE) | (matches(s, WARRANTY_TERM) & s.rlike(r"\d"))
        return (F.length(s) >= MIN_HINT) & matches(s, SLOT_WARRANTY) & term & ~(proposal_composition(s) | bank_security(s))

    return tx.let(tx.js_trim(line), tested)


def _line_slots(line: Column) -> Column:
    """Struct of the slots a line fits, tested once per line."""
    price = matches(line, SLOT_PRICE)
    return F.struct(
        line.alias("line"),
        (line.rlike(r"\d") & price).alias("price"),
        (matches(line, SLOT_PAYMENT) & ~price & concrete_payment(line)).alias("payment"),
        matches(line, SLOT_DELIVERY).alias("delivery"),
        (matches(line, SLOT_WARRANTY) & concrete_warranty(line)).alias("warranty"),
    )


def first_line_per_slot(corpus: Column) -> Column:
    """Struct of four lines: in order, each line fills at most one slot, and a slot takes its first fitting line.

    A line that fits a filled slot goes on to the next one, so the slots are filled in one fold.
    """
    cleaned = F.filter(F.transform(F.split(corpus, "\r?\n"), clean_hint_line), lambda x: F.length(x) >= MIN_HINT)
    candidates = F.filter(
        F.transform(cleaned, _line_slots), lambda s: s["price"] | s["payment"] | s["delivery"] | s["warranty"]
    )
    seed = F.struct(*[F.lit("").alias(slot) for slot in SLOTS])

    def step(acc: Column, s: Column) -> Column:
        free, takes = F.lit(True), {}
        for slot in SLOTS:
            takes[slot] = free & (acc[slot] == "") & s[slot]
            free = free & ~takes[slot]
        return F.struct(*[F.when(takes[slot], s["line"]).otherwise(acc[slot]).alias(slot) for slot in SLOTS])

    return F.aggregate(candidates, seed, step)


def terms_gate_mode(has_reduction: Column, absurd: Column) -> Column:
    return F.when(has_reduction & ~absurd, MODES[0]).when(has_reduction, MODES[1]).otherwise(MODES[2])


def terms_gate_plan(rows: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Add the mode, the slots to ask for, and those filled in from the documents."""
    c = F.col(corpus)
    step = rows.withColumns(
        {"slots": first_line_per_slot(c), "mode": terms_gate_mode(mentions_price_reduction(c), absurd_price(c))}
    )
    have = {slot: F.length(F.col(f"slots.{slot}")) >= MIN_HINT for slot in SLOTS}
    none, fake = F.col("mode") == MODES[2], F.col("mode") == MODES[1]
    ask = {slot: none | ~have[slot] | (fake if slot == "price" else F.lit(False)) for slot in SLOTS}
    queue = F.filter(F.array(*[F.when(ask[s], s) for s in SLOTS]), lambda x: x.isNotNull())
    wrapped = lambda s: F.concat(F.lit(FROM_DOCUMENTS + "\n"), F.col(f"slots.{s}"))
    prefilled = F.struct(*[F.when(~ask[s], wrapped(s)).alias(s) for s in SLOTS])
    return step.withColumns({"steps_queue": queue, "prefilled": prefilled})
