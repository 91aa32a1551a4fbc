"""Chat message expressions: commands, intents, card numbers and parts of long texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsluice.functions import text as tx
from docsluice.functions import urls
from docsluice.functions.patterns import WS, extract, matches

# Commands, aliases, patterns of intents and limits.
ALIASES = {"askarchive": "archiveask", "searcharchive": "archivesearch"}
COMMANDS = (
    "start", "help", "product", "templates", "context", "library", "orgdocs", "foundingdocs", "bundle", "ask", "tenderask",
    "tendercard", "tenderextract", "tenderkp", "tenderprice", "ingest", "newchat", "archivesearch", "archiveask",
)
DEFAULT_K, MAX_K = 8, 24
PART_CHARS, PART_LIMIT = 3800, 3900
PROCUREMENT_TOPIC = r"закупк|тендер|лот|заявк|ндс|конкурс|извещен|документ|матриц|кп\b|цена"
MAX_INTENT_CHARS, MAX_GREETING_CHARS = 140, 40
_END = r"(?:[\s,.!?…]|$)"
INTENTS = [
    ("thanks", rf"^(?:спасибо|благодарю|thanks|thx|мерси){_END}"),
    ("bye", rf"^(?:пока|до\s+свидания|goodbye|bye){_END}"),
    ("smalltalk", rf"^(?:как\s+дела|как\s+ты|how\s+are\s+you){_END}"),
    (
        "identity",
        r"^(?:кто\s+ты|ты\s+кто|что\s+ты\s+за|как\s+тебя\s+зовут|представь(?:ся|ься)|who\s+are\s+you|what\s+are\s+you)(?!\w)",
    ),
    (
        "capabilities",
        r"^(?:что\s+умеешь|чем\s+можешь|чем\s+помож|что\s+делаешь|как\s+работаешь|как\s+пользов|что\s+ты\s+умеешь)|"
        r"^(?:помоги|help)(?!\w)|(?<!\w)what\s+can\s+you(?!\w)",
    ),
]
GREETING = r"^(?:hello|hi|привет|здравствуй(?:те)?|доброе\s+утро|добрый(?:\s+(?:день|вечер|утро))?)(?:\s|$|[,.!?…])"
QUESTION = (
    r"^(?:как\s+(?!начина)|почему|зачем|что\s+(?:такое|значит|положить|написать|нужно)|объясни|расскажи|можно\s+ли|"
    r"нужно\s+ли|какой|какая|какие|где|когда|сколько)"
)
IMPORT_WORDS = (
    r"начина(?:ю|ем|ть)|подготовк|импорт|скач(?:ай|ать)|загруз(?:и|ить)|bootstrap|нов(?:ый|ая)\s+(?:тендер|закупк)"
)
TOPIC_WORDS = r"тендер|закупк|лот"


def parse_command(c: Column) -> Column:
    """Struct (name, rest) of ``/name@bot rest``; NULL for any other text."""
    s = tx.js_trim(c)
    shape = r"(?s)^/([a-zA-Z0-9_]+)(?:@[A-Za-z0-9_]+)?(?:[\s\p{Z}]+(.*))?$"
    raw = F.lower(F.regexp_extract(s, shape, 1))
    name = raw
    for alias, real in ALIASES.items():
        name = F.when(raw == alias, real).otherwise(name)
    return F.when(raw != "", F.struct(name.alias("name"), tx.js_trim(F.regexp_extract(s, shape, 2)).alias("rest")))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def parse_topk(rest: Column, default: int = DEFAULT_K) -> Column:
    """Struct (query_text, k): a number as the last of several words is k, within 1 and the maximum."""
    parts = words(rest)
    last = F.try_element_at(parts, F.lit(-1))
    given = (F.size(parts) >= 2) & last.rlike(r"^\d+$")
    k = F.least(F.lit(MAX_K), F.greatest(F.lit(1), F.coalesce(last.try_cast("int"), F.lit(MAX_K))))
    text = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    return F.struct(
        F.when(given, text).otherwise(tx.js_trim(rest)).alias("query_text"), F.when(given, k).otherwise(default).alias("k")
    )


def _layout(word: Column) -> tuple[Column, Column]:
    year = F.when(word.rlike(r"^\d{4}$"), word)
    return year, F.coalesce(F.lower(word) == "flat", F.lit(False))


def parse_tender_args(rest: Column) -> Column:
    """Struct (tender_id, year, flat, tail) of ``id [year|flat] tail``; NULL without an id."""
    parts = words(rest)
    year, flat = _layout(F.try_element_at(parts, F.lit(2)))
    taken = F.when(year.isNotNull() | flat, 2).otherwise(1)
    tail = F.array_join(F.slice(parts, taken + 1, F.lit(100_000)), " ")
    return F.when(
        F.size(parts) >= 1, F.struct(parts[0].alias("tender_id"), year.alias("year"), flat.alias("flat"), tail.alias("tail"))
    )


def parse_price_args(rest: Column) -> Column:
    """As above for prices: the id has 4 to 15 digits and something must follow."""
    args = parse_tender_args(rest)
    return F.when(args["tender_id"].rlike(r"^\d{4,15}$") & (args["tail"] != ""), args)


def intent(c: Column) -> Column:
    """Everyday intent of a short message without a procurement topic, NULL otherwise."""
    s = tx.strip_mentions(c)
    out = F.when((s == "") | (F.length(s) > MAX_INTENT_CHARS) | matches(s, PROCUREMENT_TOPIC), None)
    for name, pattern in INTENTS:
        out = out.when(matches(s, pattern), name)
    return out


def is_greeting(c: Column) -> Column:
    s = tx.strip_mentions(c)
    return (s != "") & (F.length(s) <= MAX_GREETING_CHARS) & matches(s, GREETING)


def resolve_view_id(c: Column, view_url: str) -> Column:
    """Card number of a message: digits alone, an address, ``№`` and 6-10 digits, or a topic word and 6-10 digits."""
    s = tx.js_trim(c)
    numbered = extract(s, r"(?:№|#|no\.?\s)\s*(\d{6,10})(?!\w)")
    by_topic = F.when(matches(s, TOPIC_WORDS + "|view"), extract(s, r"(?<!\w)(\d{6,10})(?!\w)"))
    return F.coalesce(
        F.when(s.rlike(r"^\d+$"), s), F.try_element_at(urls.view_ids(s, view_url), F.lit(1)), numbered, by_topic
    )


def should_import(c: Column, view_url: str) -> Column:
    """Whether a message asks to import a card rather than asking about one."""
    s = tx.js_trim(c)
    linked = F.size(urls.view_ids(s, view_url)) > 0
    topic = matches(s, TOPIC_WORDS)
    number = s.rlike(r"(?:№|#)\s*\d{6,10}") & topic
    plain = topic & matches(s, r"(?<!\w)\d{6,10}(?!\w)")
    asks = matches(s, QUESTION) & ~matches(s, r"начина(?:ю|ем|ть)|импорт|bootstrap")
    found = resolve_view_id(s, view_url).isNotNull()
    return F.coalesce(
        linked | (found & (s.rlike(r"^\d+$") | matches(s, IMPORT_WORDS) | number | (plain & ~asks))), F.lit(False)
    )


def has_context(c: Column, reply_to_bot: Column, view_url: str) -> Column:
    """A group message is tied to a procurement: a reply to the bot, an address, or 6-10 digits."""
    return F.coalesce(
        reply_to_bot | (F.size(urls.view_ids(c, view_url)) > 0) | matches(c, r"(?<!\w)\d{6,10}(?!\w)"), F.lit(False)
    )


def starts_with_other_mention(c: Column, chat_type: Column, entities: Column, bot: str, bot_id: int) -> Column:
    """A group message that begins with a mention of somebody else.

    entities: array<struct<type, offset, length, user_id>>; without any, the text itself decides.
    """
    start = F.length(c) - F.length(F.ltrim(c))
    mentions = F.filter(entities, lambda e: e["type"].isin("mention", "text_mention") & (e["offset"] >= start))
    ordered = F.array_sort(
        F.transform(mentions, lambda e: F.struct(*[e[n].alias(n) for n in ("offset", "length", "type", "user_id")]))
    )
    first = F.try_element_at(ordered, F.lit(1))
    gap = F.substring(c, start + 1, first["offset"] - start)
    shown = F.lower(F.substring(c, first["offset"] + 1, first["length"]))
    own = F.when(first["type"] == "text_mention", F.coalesce(first["user_id"] == bot_id, F.lit(False))).otherwise(
        shown == f"@{bot.lower()}"
    )
    by_entity = first.isNotNull() & ~tx.non_blank(gap) & ~own
    named = F.lower(F.regexp_extract(F.ltrim(c), r"^@([A-Za-z0-9_]{3,})", 1))
    by_text = (named != "") & (named != bot.lower())
    decided = F.when(F.coalesce(F.size(entities) > 0, F.lit(False)), by_entity).otherwise(by_text)
    return chat_type.isin("group", "supergroup") & F.coalesce(decided, F.lit(False))


def message_parts(c: Column, size: int = PART_CHARS, limit: int = PART_LIMIT) -> Column:
    """Array of parts of a long text, in one pass; parts after the first say so, and none exceeds the limit."""
    parts = F.regexp_extract_all(c, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    shown = F.transform(
        parts, lambda p, i: F.when(i > 0, F.concat(F.lit("(продолжение "), (i + 1).cast("string"), F.lit(")\n"), p)).otherwise(p)
    )
    return F.transform(shown, lambda p: tx.truncate_marked(p, limit, "\n\n…(обрезано)"))
