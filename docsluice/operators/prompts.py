"""Prompt assembly and reading replies: texts per key from ranked hits, corpora and flags.

Prompts that hold all files or all lines of a tender come in numbered parts, so no tender is held as one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions import json as js
from docsluice.functions import text as tx
from docsluice.functions.ranking import distributed_rank, ordered_bucket
from docsluice.operators import assembly, inventory, policy, search
from docsluice.operators.parts import PART_CHARS, numbered_parts, with_ends

# Headings, separators, limits and default texts.
HIT_SEPARATOR, CONTEXT_SEPARATOR = "\n\n---\n\n", "\n---\n"
CONTEXT_HITS = 6
QUESTION = "Вопрос пользователя: "
NO_VALUE = "—"
NO_TEXT, NO_CARD = "_(пусто)_", "_(нет)_"
CORPUS_HEADING = "### Текст документов заказчика"
SNIPPETS_HEADING = "### Фрагменты из inputs"
CARD_HEADING = "### Фрагмент карточки (только текст)"
ARCHIVE_HEADING = "### Фрагменты архива"
MATRIX_HEADER = "| № | Требование / документ | Роль | Суть (по документам) |\n|---|---|---|---|"
EMPTY_MATRIX = "_(В распарсенном тексте нет строк матрицы с дословной цитатой.)_"
MANAGER_ROLE = "Менеджер"
QUOTE_HEADING = "### Согласованная цена и условия"
POLICY_HEADING = "## Политика цены"
PREPARATION_MISSING = "нет подготовленного входа и согласованной цены"
MODE_STARTING = "стартовое предложение допустимо"
MODE_MANAGER = "цену согласовать с менеджером"
PRICE_ABSURD = "- В тексте закупки встречается **подозрительно малая цена или заглушка**."
PRICE_REDUCTION = "- По тексту закупки **предусмотрена процедура снижения**."
PRICE_NONE = "- По переданному тексту **процедура снижения не выявлена**."
IMPORT_DONE = "**Импорт выполнен**"


def rag_prompt(hits: DataFrame, questions: DataFrame, lead: str = "") -> DataFrame:
    """(query_id, prompt): ranked hit blocks joined, then the question.

    hits: query_id, hit_rank, score, path, text — at most k per query.
    """
    block = search.hit_block(F.col("hit_rank"), F.col("score"), F.col("path"), F.col("text"))
    rows = hits.select("query_id", "hit_rank", block.alias("block"))
    joined = rows.groupBy("query_id").agg(assembly.joined_in_order("block", "hit_rank", HIT_SEPARATOR).alias("blocks"))
    asked = joined.join(questions, "query_id")
    text = F.concat_ws("\n", F.lit(lead), F.lit(""), "blocks", F.lit(""), F.concat(F.lit(QUESTION), tx.js_trim(F.col("question"))))
    return asked.select("query_id", text.alias("prompt"))


def archive_context(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, archive): whole texts of the first hits."""
    rows = hits.where(F.col("hit_rank") <= CONTEXT_HITS).select(key, "hit_rank", tx.js_trim(F.col("text")).alias("text"))
    return rows.where(F.col("text") != "").groupBy(key).agg(
        assembly.joined_in_order("text", "hit_rank", CONTEXT_SEPARATOR).alias("archive")
    )


def _sections(*parts: Column) -> Column:
    """Parts as lines, the empty ones left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p != "", F.lit(False))), "\n")


def analysis_prompt(corpora: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """(tender_id, prompt) of tenders with enough text: id, corpus block, optional archive block.

    corpora: tender_id, corpus, parsed (whether the corpus comes from parsed files).
    """
    rows = corpora.where(assembly.collapsed_length(F.col("corpus")) >= assembly.MIN_ANALYSIS_CHARS)
    block = F.lit(NO_CARD)
    if archive is not None:
        rows = rows.join(archive, "tender_id", "left")
        block = F.when(F.length("archive") > 20, F.col("archive")).otherwise(NO_CARD)
    heading = F.when(F.col("parsed"), CORPUS_HEADING).otherwise(SNIPPETS_HEADING)
    text = F.concat_ws(
        "\n", F.concat(F.lit("tender_id: "), "tender_id"), F.lit(""), heading, "corpus", F.lit(""), F.lit(ARCHIVE_HEADING), block
    )
    return rows.select("tender_id", text.alias("prompt"))


def card_prompt(corpora: DataFrame, cards: DataFrame) -> DataFrame:
    """(tender_id, prompt) from a corpus and the beginning of the card's text, either of which may be missing."""
    joined = corpora.join(cards.select("tender_id", F.col("card_text").alias("card")), "tender_id", "left")
    filled = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    text = F.concat_ws(
        "\n", F.concat(F.lit("tender_id / view: "), "tender_id"), F.lit(""), F.lit(CORPUS_HEADING), filled("corpus", NO_TEXT), F.lit(""),
        F.lit(CARD_HEADING), filled("card", NO_CARD),
    )
    return joined.select("tender_id", text.alias("prompt"))


def price_quote_merge(preparations: DataFrame, quotes: DataFrame, key: str = "tender_id") -> DataFrame:
    """The manager's latest quote in front of the preparation text; a warning where both are missing.

    quotes: key, saved_at, quote.
    """
    latest = quotes.groupBy(key).agg(F.max_by("quote", "saved_at").alias("_quote"))
    joined = preparations.join(latest, key, "left")
    quote = F.nullif(tx.js_trim(F.col("_quote")), F.lit(""))
    preparation = F.coalesce(tx.js_trim(F.col("preparation")), F.lit(""))
    merged = F.when(quote.isNotNull(), _sections(F.lit(QUOTE_HEADING), quote, F.lit("---"), preparation)).otherwise(preparation)
    return joined.select(
        *[c for c in preparations.columns if c != "preparation"],
        merged.alias("preparation"),
        quote.isNotNull().alias("has_quote"),
        F.when(quote.isNull() & (preparation == ""), PREPARATION_MISSING).alias("warning"),
    )


def matrix_numbering(claims: DataFrame, self_role: str) -> DataFrame:
    """Rows of both claim lists of a tender under one running number: the own list first.

    claims: tender_id, list, ord, name, basis, criteria.  Rows are counted per stretch of ``ord`` and then over stretches,
    so a tender that holds most claims is not sorted in one task.
    """
    later = F.when(F.col("list") == "self", 0).otherwise(1)
    cell = inventory.markdown_cell
    criteria = F.when(F.col("list") == "self", "").when(F.coalesce(F.col("criteria"), F.lit("")).isin("", NO_VALUE), "").otherwise(
        F.concat(F.lit(" "), cell(F.col("criteria")))
    )
    role = F.when(F.col("list") == "self", self_role).otherwise(MANAGER_ROLE)
    split = claims.withColumn("_list", later)
    numbered = distributed_rank(split, ["tender_id"], ["_list", "ord"], [F.col("_list"), ordered_bucket(F.col("ord"), claims)], out="n")
    line = F.concat(
        F.lit("| "), F.col("n").cast("string"), F.lit(" | "), cell(F.col("name")), F.lit(" | "), role, F.lit(" | "), cell(F.col("basis")),
        criteria, F.lit(" |"),
    )
    return numbered.select("tender_id", "n", line.alias("line"))


def matrix_bullet(claim_list: Column, name: Column, basis: Column, criteria: Column) -> Column:
    row = F.concat(F.lit("- **"), name, F.lit("** — "), basis)
    more = (claim_list == "manager") & ~F.coalesce(criteria, F.lit("")).isin("", NO_VALUE)
    return F.when(more, F.concat(row, F.lit(" _("), criteria, F.lit(")_"))).otherwise(row)


def preparation_prompt(fields: DataFrame, matrix: DataFrame, flags: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(tender_id, part, start, text): front matter, summary, price rules by the flags, then every line of the matrix."""
    rows = fields.join(flags.select("tender_id", "has_reduction", "absurd"), "tender_id", "left")
    rows = rows.join(matrix.select("tender_id").distinct().withColumn("_lines", F.lit(True)), "tender_id", "left")
    price = F.when(F.col("absurd"), PRICE_ABSURD).when(F.col("has_reduction"), PRICE_REDUCTION).otherwise(PRICE_NONE)
    shown = lambda label, c: F.concat(F.lit(f"- **{label}:** "), F.coalesce(F.nullif(c, F.lit("")), F.lit(NO_VALUE)))
    opening = _sections(
        F.lit("---"), F.concat(F.lit("tender_id: "), F.col("tender_id").cast("string")), F.lit("---"),
        shown("Наименование / предмет", "title"), shown("Сумма / бюджет в тексте", "budget"), shown("Способ подачи", "method"),
        shown("Дедлайн приёма", "deadline"), F.concat(F.lit("- **Перечень / подача (кратко):** "), F.col("overview")),
        F.lit("## Политика цены в КП"), price, F.lit("## Матрица требований"), F.when(F.col("_lines"), MATRIX_HEADER).otherwise(EMPTY_MATRIX),
    )
    lines = matrix.join(fields.select("tender_id"), "tender_id", "left_semi").select("tender_id", "n", F.col("line").alias("text"))
    pieces = with_ends(lines, "tender_id", rows.select("tender_id", opening.alias("text")))
    return numbered_parts(pieces, "tender_id", ["_rank", "n"], [F.col("_rank"), ordered_bucket(F.col("n"), matrix)], "\n", part_chars)


def commercial_pack(analysed: DataFrame, label: str = "tender_id") -> DataFrame:
    """Add the mode line, the flags line and the reasons of a price analysis."""
    yes = lambda c: F.when(c, "да").otherwise("нет")
    starting = F.col("pricing_mode") == "starting_offer_allowed"
    flags = F.concat(
        F.lit("процедура снижения="), yes(F.col("has_reduction")), F.lit("; подозрительная опорная цена="), yes(F.col("suspicious"))
    )
    reasons = F.array(
        F.when(F.col("has_reduction"), "reduction_found").otherwise("reduction_missing"),
        F.when(F.col("has_reduction") & F.col("reference_price").isNotNull(), F.concat(F.lit("reference: "), "reference_raw"))
        .when(F.col("has_reduction"), "reference_missing"),
        F.when(F.col("suspicious"), F.lit(f"reference below {policy.MIN_SANITY:.0f}")),
    )
    return analysed.select(
        "*",
        F.concat(F.lit("Закупка: "), F.col(label).cast("string")).alias("label"),
        F.when(starting, MODE_STARTING).otherwise(MODE_MANAGER).alias("mode_line"),
        flags.alias("flags_line"),
        F.array_join(F.filter(reasons, lambda r: r.isNotNull()), "\n").alias("reasons"),
    )


def price_policy(analysed: DataFrame, key: str = "tender_id") -> DataFrame:
    """(key, policy): the price section of a proposal as rules that a completion provider words.

    analysed: key, has_quote (the manager has set a price), absurd, below_threshold, has_reduction.  A quote rules out
    placeholders; without one a price is agreed first where it is absurd, below the threshold or may not be improved
    later, and is an opening price where it may.
    """
    reasons = F.array(F.when(F.col("absurd"), "absurd_price"), F.when(F.col("below_threshold"), "below_threshold"), F.when(~F.col("has_reduction"), "no_reduction"))
    reasons = F.filter(reasons, lambda r: r.isNotNull())
    rules = (
        F.when(F.col("has_quote"), F.array(F.lit("use_agreed_price"), F.lit("no_placeholders"), F.when(F.col("has_reduction"), "opening_price")))
        .when(F.size(reasons) > 0, F.array(F.concat(F.lit("agree_price: "), F.array_join(reasons, ", ")), F.lit("no_own_total")))
        .otherwise(F.array(F.lit("opening_price"), F.lit("no_further_reduction"), F.lit("vat_as_in_documents")))
    )
    rules = F.when(F.col("has_quote"), rules).otherwise(F.concat(rules, F.array(F.lit("figures_with_source"), F.lit("no_invented_terms"))))
    lines = F.transform(F.filter(rules, lambda r: r.isNotNull()), lambda r: F.concat(F.lit("- "), r))
    return analysed.select(key, F.concat(F.lit(POLICY_HEADING + "\n"), F.array_join(lines, "\n")).alias("policy"))


def proposal_prompt(rows: DataFrame, corpora: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(tender_id, part, start, text) from the columns preparation, organisation, requisites, policy and warnings of
    ``rows``, blanks left out, and then the whole corpus.

    corpora: tender_id, part, text.
    """
    requisites = tx.js_trim(F.col("requisites"))
    warned = F.when(F.size("warnings") > 0, F.concat(F.lit("**Предупреждения:** "), F.array_join("warnings", " | ")))
    opening = _sections(
        F.concat(F.lit("Тендер: **"), F.col("tender_id").cast("string"), F.lit("**")), F.col("preparation"), F.col("organisation"), requisites,
        F.col("policy"), warned, F.lit("## Корпус (документация заказчика)\n"),
    )
    known = corpora.join(rows.select("tender_id"), "tender_id", "left_semi").select("tender_id", "part", "text")
    pieces = with_ends(known, "tender_id", rows.select("tender_id", opening.alias("text")))
    return numbered_parts(pieces, "tender_id", ["_rank", "part"], [F.col("_rank"), F.floor(F.col("part") / 1024)], "", part_chars)


def bundle_prompt(bundle: DataFrame, questions: DataFrame, key: str = "tender_id", part_chars: int = PART_CHARS) -> DataFrame:
    """(key, part, start, text): the whole bundle as JSON in order of name, then the question.

    bundle: key, file_id, name, json; questions: key, question.
    """
    asked = questions.join(bundle.select(key).distinct(), key, "left_semi")
    entries = bundle.join(asked.select(key), key, "left_semi")
    first = entries.groupBy(key).agg(F.min(F.struct("name", "file_id")).alias("_first"))
    comma = F.when(F.struct("name", "file_id") == F.col("_first"), "").otherwise(",")
    pieces = entries.join(first, key).select(key, "name", "file_id", F.concat(comma, "json").alias("text"))
    closing = F.concat(F.lit("]\n\n" + QUESTION), tx.js_trim(F.col("question")))
    ended = with_ends(pieces, key, asked.select(key, F.lit("[").alias("text")), asked.select(key, closing.alias("text")))
    return numbered_parts(ended, key, ["_rank", "name", "file_id"], [F.col("_rank"), ordered_bucket(F.col("name"), bundle)], "", part_chars)


def import_summary(snapshots: DataFrame) -> DataFrame:
    """(view_id, summary) of imported cards: title, customer, sum, deadline and where the documents are.

    snapshots: view_id, title, customer, budget_hint, deadline_hint, folder_link, document_links, url.
    """
    shown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(NO_VALUE))
    title = tx.js_trim(F.col("title"))
    heading = F.when(F.length(title) >= 8, title).otherwise(F.concat(F.lit("Закупка "), F.col("view_id").cast("string")))
    first = F.try_element_at("document_links", F.lit(1))["href"]
    where = (
        F.when(F.col("folder_link") != "", F.concat(F.lit("Документация: "), "folder_link"))
        .when(first.isNotNull(), F.concat(F.lit("Документация (ссылка с карточки): "), first))
        .when(F.col("url") != "", F.concat(F.lit("Карточка закупки: "), "url"))
        .otherwise("Ссылка на комплект: —")
    )
    text = F.concat_ws(
        "\n", F.lit(IMPORT_DONE), F.lit(""), F.concat(F.lit("**Наименование:** "), heading),
        F.concat(F.lit("**Заказчик:** "), shown("customer")), F.concat(F.lit("**Сумма / стоимость:** "), shown("budget_hint")),
        F.concat(F.lit("**Дата подачи / дедлайн:** "), shown("deadline_hint")), where, F.lit(""),
        F.concat(F.lit("**Номер:** "), F.col("view_id").cast("string")),
    )
    return snapshots.select("view_id", text.alias("summary"))


def read_replies(replies: DataFrame, key: str = "tender_id", reply: str = "reply") -> DataFrame:
    """Add ``doc``, the parsed reply; unparsable ones have NULL and go to ``rejected_replies``."""
    return replies.withColumn("doc", js.lenient_json(F.col(reply)))


def rejected_replies(parsed: DataFrame, key: str = "tender_id", reply: str = "reply") -> DataFrame:
    return parsed.where(F.col("doc").isNull()).select(key, F.col(reply).alias("reply"))


def reply_claims(parsed: DataFrame, lists: dict[str, str], key: str = "tender_id") -> DataFrame:
    """Claims of parsed replies as rows; ``lists`` maps a JSON array to the list it fills.  Unnamed items are dropped."""
    doc = F.col("doc")
    arrays = [_tagged(js.items_at(doc, path), name) for path, name in lists.items()]
    # An unread reply has empty lists.  A filter on the reply would have it parsed twice, once below the scan's spread.
    rows = parsed.select(key, F.inline(F.concat(*arrays)))
    return rows.where(F.col("name").isNotNull())


def _tagged(items: Column, name: str) -> Column:
    def one(x: Column, i: Column) -> Column:
        basis = F.coalesce(js.string_at(x, "basis"), js.string_at(x, "reason"), F.lit(NO_VALUE))
        return F.struct(
            F.lit(name).alias("list"), i.alias("ord"), js.string_at(x, "name").alias("name"), basis.alias("basis"),
            F.coalesce(js.string_at(x, "criteria"), F.lit("")).alias("criteria"),
            F.coalesce(js.string_at(x, "evidence"), F.lit("")).alias("evidence"),
        )

    return F.transform(items, one)


def reply_card(parsed: DataFrame, key: str = "tender_id") -> DataFrame:
    """Card fields of parsed replies: trimmed strings with a dash for what is missing, and the named documents."""
    doc = F.col("doc")
    shown = lambda path: F.coalesce(js.string_at(doc, path), F.lit(NO_VALUE))
    names = F.transform(js.items_at(doc, "requiredDocumentNames"), _plain_string)
    return parsed.where(doc.isNotNull()).select(
        key, shown("tenderTitle").alias("title"), shown("priceInfo").alias("price_info"), shown("submissionDeadline").alias("deadline"),
        F.filter(names, lambda n: n.isNotNull()).alias("document_names"),
    )


def _plain_string(x: Column) -> Column:
    return F.nullif(tx.js_trim(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), F.lit(""))
