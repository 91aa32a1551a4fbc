"""Queries of price and terms rules: every order becomes a short Russian corpus, documents take stand-in patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.functions import money
from docsluice.operators import policy
from docsluice.plans.registry import Tables, query
from docsluice.session import spread


def order_corpora(t: Tables, *more: str) -> DataFrame:
    """Orders as texts, with more of their columns if asked for."""
    p, s, price = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
    amount = F.when(s == "F", F.format_string("%.2f", price)).when(s == "O", F.format_string("%.2f", F.floor(price / 100).cast("double"))).otherwise("1")
    procedure = F.when(p == "1-URGENT", "Процедура улучшения предложений участников").when(p == "2-HIGH", "Возможно добровольное снижение цены").otherwise(
        "Условия без торгов"
    )
    payment = (
        F.when(p == "1-URGENT", "Оплата: предоплата 30 % и расчёт в течение 5 рабочих дней")
        .when(p == "2-HIGH", "Предложение должно содержать условия оплаты и сроки")
        .when(p == "3-MEDIUM", "Банковская гарантия на возврат аванса обязательна")
        .otherwise("Оплата после подписания акта")
    )
    warranty = F.when(s == "P", "Гарантийные обязательства указать").otherwise("- Гарантийный срок 24 месяца")
    corpus = F.concat_ws(
        "\n", F.concat(F.lit("Поставка № "), F.col("o_orderkey").cast("string")), procedure,
        F.concat(F.lit("* Начальная цена лота: "), amount, F.lit(" BYN")), payment, F.lit("Срок поставки 30 календарных дней"), warranty,
    )
    return spread(t.orders.select("o_orderkey", "o_totalprice", corpus.alias("corpus"), *more))


_SQL = """
SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s, CASE o_orderstatus WHEN 'F' THEN round(o_totalprice, 2) WHEN 'O' THEN floor(o_totalprice / 100) ELSE 1 END AS amount,
  CASE o_orderstatus WHEN 'F' THEN printf('%.2f', o_totalprice) WHEN 'O' THEN printf('%.2f', floor(o_totalprice / 100)) ELSE '1' END AS shown,
  o_orderpriority IN ('1-URGENT', '2-HIGH') AS reduction, o_orderstatus = 'P' OR (o_orderstatus = 'O' AND floor(o_totalprice / 100) BETWEEN 1 AND 5) AS absurd
FROM orders"""


@query("mentions_price_reduction", f"SELECT o_orderkey, reduction, p IN ('1-URGENT', '2-HIGH') AS short FROM ({_SQL})")
def _reduction(t: Tables) -> DataFrame:
    c = F.col("corpus")
    return order_corpora(t).select(
        "o_orderkey", policy.mentions_price_reduction(c).alias("reduction"), policy.mentions_reduction_short(c).alias("short")
    )


@query(
    "mentions_stand_in",
    """
SELECT doc_id, regexp_matches(text, '(?i)tion[\\pL\\pN_]*\\s+the|elle[\\pL\\pN_]*\\s+le|der\\s+[\\pL\\pN_]*ung') AS found FROM documents
""",
)
def _stand_in(t: Tables) -> DataFrame:
    """The rule over whole documents with patterns of their languages."""
    found = policy.mentions_price_reduction(F.col("text"), [r"tion\w*\s+the", r"elle\w*\s+le", r"der\s+\w*ung"])
    return t.spread("documents", "doc_id", "text").select("doc_id", found.alias("found"))


@query(
    "absurd_price",
    f"SELECT o_orderkey, absurd FROM ({_SQL})",
)
def _absurd(t: Tables) -> DataFrame:
    return order_corpora(t).select("o_orderkey", policy.absurd_price(F.col("corpus")).alias("absurd"))


@query("price_below_threshold", f"SELECT o_orderkey, amount > 0 AND amount < 10000 AS below FROM ({_SQL})")
def _below(t: Tables) -> DataFrame:
    return order_corpora(t).select("o_orderkey", policy.price_below_threshold(F.col("corpus")).alias("below"))


@query("has_price_ceiling", f"SELECT o_orderkey, amount >= 50 AS ceiling FROM ({_SQL})")
def _ceiling(t: Tables) -> DataFrame:
    return order_corpora(t).select("o_orderkey", policy.has_price_ceiling(F.col("corpus")).alias("ceiling"))


@query(
    "price_coordination",
    f"""
SELECT o_orderkey, reduction AS has_reduction, absurd, amount > 0 AND amount < 10000 AS below_threshold, amount >= 50 AS has_ceiling, NOT reduction AS no_procedure,
  absurd OR (amount > 0 AND amount < 10000) OR NOT reduction AS needs_coordination,
  concat_ws('|', CASE WHEN amount < 50 THEN '{policy.HINT_NO_CEILING}' END, CASE WHEN NOT reduction THEN '{policy.HINT_NO_REDUCTION}' END,
    CASE WHEN amount >= 50 AND reduction THEN '{policy.HINT_BOTH}' END) AS manager_hints FROM ({_SQL})
""",
)
def _coordination(t: Tables) -> DataFrame:
    out = policy.price_coordination(order_corpora(t)).drop("corpus", "o_totalprice")
    return out.withColumn("manager_hints", F.array_join("manager_hints", "|"))


@query(
    "price_analysis",
    f"""
SELECT o_orderkey, reduction AS has_reduction, price AS reference_price, raw AS reference_raw, price > 0 AND price < 100 AS suspicious,
  CASE WHEN reduction AND NOT (price > 0 AND price < 100) THEN 'starting_offer_allowed' ELSE 'manager_price_required' END AS pricing_mode
FROM (SELECT *, CASE WHEN p = '5-LOW' THEN 2500.0 * 1000 WHEN amount = 0 THEN NULL ELSE amount END AS price,
        CASE WHEN p = '5-LOW' THEN '2 500 тыс. BYN' WHEN amount = 0 THEN NULL ELSE shown || ' BYN' END AS raw FROM ({_SQL}))
""",
)
def _analysis(t: Tables) -> DataFrame:
    """Low-priority orders bring an estimate from their card."""
    rows = order_corpora(t, "o_orderpriority").withColumn("estimate", F.when(F.col("o_orderpriority") == "5-LOW", " 2 500 тыс. BYN "))
    return policy.price_analysis(rows).select(
        "o_orderkey", "has_reduction", "reference_price", "reference_raw", "suspicious", "pricing_mode"
    )


_SQL_SLOTS = f"""
SELECT o_orderkey, reduction, absurd, 'Начальная цена лота: ' || shown || ' BYN' AS price,
  CASE p WHEN '1-URGENT' THEN 'Оплата: предоплата 30 % и расчёт в течение 5 рабочих дней' WHEN '2-HIGH' THEN '' WHEN '3-MEDIUM' THEN ''
    ELSE 'Оплата после подписания акта' END AS payment,
  'Срок поставки 30 календарных дней' AS delivery, CASE WHEN s = 'P' THEN '' ELSE 'Гарантийный срок 24 месяца' END AS warranty FROM ({_SQL})"""


@query("first_line_per_slot", f"SELECT o_orderkey, price, payment, delivery, warranty FROM ({_SQL_SLOTS})")
def _slots(t: Tables) -> DataFrame:
    rows = order_corpora(t).select("o_orderkey", F.inline(F.array(policy.first_line_per_slot(F.col("corpus")))))
    return rows.select("o_orderkey", *policy.SLOTS)


@query(
    "terms_line_predicates",
    f"""
SELECT o_orderkey, p IN ('1-URGENT', '4-NOT SPECIFIED', '5-LOW') AS payment, p = '2-HIGH' AS composition, p = '3-MEDIUM' AS bank, s <> 'P' AS warranty FROM ({_SQL})
""",
)
def _predicates(t: Tables) -> DataFrame:
    raw = order_corpora(t).select("o_orderkey", F.explode(F.split("corpus", "\n")).alias("raw"))
    lines, line = raw.select("o_orderkey", policy.clean_hint_line(F.col("raw")).alias("line")), F.col("line")
    flags = lines.select(
        "o_orderkey", (policy.concrete_payment(line) & line.startswith("Оплата")).alias("payment"),
        (policy.proposal_composition(line) & policy.mandatory_contents(line)).alias("composition"), policy.bank_security(line).alias("bank"),
        policy.concrete_warranty(line).alias("warranty"),
    )
    return flags.groupBy("o_orderkey").agg(*[F.bool_or(c).alias(c) for c in ("payment", "composition", "bank", "warranty")])


@query(
    "terms_gate_plan",
    f"""
SELECT o_orderkey, mode, concat_ws(',', CASE WHEN none OR mode = 'reduction_fake_price' THEN 'price' END, CASE WHEN none OR payment = '' THEN 'payment' END,
    CASE WHEN none THEN 'delivery' END, CASE WHEN none OR warranty = '' THEN 'warranty' END) AS queue,
  CASE WHEN NOT none AND payment <> '' THEN '{policy.FROM_DOCUMENTS}' || chr(10) || payment END AS payment
FROM (SELECT *, mode = 'no_reduction' AS none FROM (
  SELECT *, CASE WHEN reduction AND NOT absurd THEN 'reduction_docs_ok' WHEN reduction THEN 'reduction_fake_price' ELSE 'no_reduction' END AS mode FROM ({_SQL_SLOTS})))
""",
)
def _plan(t: Tables) -> DataFrame:
    plan = policy.terms_gate_plan(order_corpora(t))
    return plan.select("o_orderkey", "mode", F.array_join("steps_queue", ",").alias("queue"), "prefilled.payment")


@query(
    "terms_gate_mode",
    f"SELECT mode, count(*) AS n FROM (SELECT CASE WHEN reduction AND NOT absurd THEN 'reduction_docs_ok' WHEN reduction THEN 'reduction_fake_price' ELSE 'no_reduction' END AS mode FROM ({_SQL})) GROUP BY 1",
)
def _mode(t: Tables) -> DataFrame:
    c = F.col("corpus")
    mode = policy.terms_gate_mode(policy.mentions_price_reduction(c), policy.absurd_price(c))
    return order_corpora(t).groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


@query(
    "parse_money",
    """
SELECT o_orderkey, round(o_totalprice, 2) AS grouped, CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice) * 1000 WHEN o_orderstatus = 'O' THEN floor(o_totalprice) * 1000000 END AS scaled FROM orders
""",
)
def _money(t: Tables) -> DataFrame:
    """Prices with blank groups and a decimal comma; whole ones as thousands or millions; the rest is no amount."""
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    grouped = F.concat(F.translate(F.format_number(price, 2), ",.", chr(160) + ","), F.lit(" бел. рублей"))
    whole = F.floor(price).cast("string")
    scaled = F.when(status == "F", F.concat(whole, F.lit(" тыс. руб."))).when(status == "O", F.concat(whole, F.lit("  млн  BYN"))).otherwise("по смете")
    return t.orders.select("o_orderkey", F.round(money.parse_money(grouped), 2).alias("grouped"), money.parse_money(scaled).alias("scaled"))


def _sql_triplet(n: str, ones: list[str]) -> str:
    pick = lambda words, at: f"nullif(list_extract({words!r}, CAST({at} AS BIGINT) + 1), '')"
    tens, one = f"(({n}) // 10 % 10)", f"(({n}) % 10)"
    return (
        f"concat_ws(' ', {pick(money.HUNDREDS, f'({n}) // 100')}, CASE WHEN {tens} = 1 THEN {pick(money.TEENS, one)} ELSE {pick(money.TENS, tens)} END, "
        f"CASE WHEN {tens} <> 1 THEN {pick(ones, one)} END)"
    )


def _sql_plural(n: str, forms: tuple[str, str, str]) -> str:
    return (
        f"CASE WHEN ({n}) % 100 BETWEEN 11 AND 14 THEN '{forms[2]}' WHEN ({n}) % 10 = 1 THEN '{forms[0]}' "
        f"WHEN ({n}) % 10 BETWEEN 2 AND 4 THEN '{forms[1]}' ELSE '{forms[2]}' END"
    )


def _sql_group(n: str, forms: tuple[str, str, str], ones: list[str], empty: str) -> str:
    return f"CASE WHEN ({n}) > 0 THEN concat_ws(' ', {_sql_triplet(n, ones)}, {_sql_plural(n, forms)}) ELSE {empty} END"


@query(
    "amount_words_ru",
    "SELECT o_orderkey, concat_ws(' ', "
    + ", ".join(
        [
            _sql_group("x // 1000000 % 1000", money.GROUPS[1], money.ONES_M, "NULL"),
            _sql_group("x // 1000 % 1000", money.GROUPS[2], money.ONES_F, "NULL"),
            _sql_group("x % 1000", money.GROUPS[3], money.ONES_M, f"'{money.GROUPS[3][2]}'"),
        ]
    )
    + ") AS words FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 7 AS x FROM orders)",
)
def _words(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", money.amount_words(F.floor("o_totalprice") * 7).alias("words"))


@query(
    "plural_ru",
    f"SELECT l_orderkey, l_partkey, l_linenumber, {_sql_plural('l_partkey', money.GROUPS[2])} AS form FROM lineitem",
)
def _plural(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", money.plural_ru(F.col("l_partkey"), money.GROUPS[2]).alias("form")
    )
