"""Queries of message jobs over ``conversations`` and ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsluice.functions import messages as mx
from docsluice.functions import text as tx
from docsluice.functions import urls
from docsluice.operators import messages as ms
from docsluice.plans.registry import Tables, query, sql_collapse, sql_trim
from docsluice.session import rocksdb_state, shared_folder
from docsluice.sources import readers, sinks
from docsluice.streaming import flows

VIEW_URL = "portal.example.com/tenders/all/view/"


@query(
    "allowed_chats",
    "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)",
)
def _allowed(t: Tables) -> DataFrame:
    chats = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("user_id"))
    return ms.allowed_chats(t.events, chats, "user_id").select("event_id", "user_id")


_SQL_LAST = """
SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations"""


@query("rolling_history", f"SELECT conv_id, turn, role, text FROM ({_SQL_LAST}) WHERE n <= 10")
def _history(t: Tables) -> DataFrame:
    return ms.rolling_history(t.conversations, "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query(
    "history_state",
    """
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM (
  SELECT c.* FROM conversations c LEFT JOIN (SELECT conv_id, max(turn) AS at FROM conversations WHERE length(text) < 120 GROUP BY 1) r USING (conv_id)
  WHERE length(text) >= 120 AND (r.at IS NULL OR turn > r.at))) WHERE n <= 10
""",
)
def _history_state(t: Tables) -> DataFrame:
    """Short messages stand in for /newchat."""
    out = ms.history_after_reset(t.conversations, "conv_id", "turn", F.length("text") < 120)
    return out.select("conv_id", "turn", "role")


@query(
    "clean_message",
    f"SELECT conv_id, turn, {sql_trim('text')} AS body FROM conversations",
)
def _clean(t: Tables) -> DataFrame:
    """Every text gets a zero-width mark, which cleaning removes; NFC leaves the composed texts as they are."""
    marked = F.concat(F.lit(chr(0x200B)), F.substring("text", 1, 3), F.lit(chr(0xFEFF)), F.expr("substring(text, 4)"))
    return t.conversations.select("conv_id", "turn", tx.clean_message(marked).alias("body"))


# Messages with commands, numbers and links in front of the given texts, by role and length.
_SQL_COMMANDS = """
SELECT conv_id, turn, text, CASE WHEN length(text) < 200 THEN '/AskArchive@my_bot ' || text || ' 12' WHEN length(text) < 400 THEN '/tenderprice ' || (conv_id + 10000) || ' 2024 ' || text
  WHEN length(text) < 600 THEN '/bundle ' || (conv_id + 10000) || ' FLAT' WHEN length(text) < 800 THEN '/searcharchive word 99' ELSE text END AS message FROM conversations"""


def command_messages(t: Tables) -> DataFrame:
    n = F.length("text")
    number = (F.col("conv_id") + 10_000).cast("string")
    message = (
        F.when(n < 200, F.concat(F.lit("/AskArchive@my_bot "), "text", F.lit(" 12")))
        .when(n < 400, F.concat(F.lit("/tenderprice "), number, F.lit(" 2024 "), "text"))
        .when(n < 600, F.concat(F.lit("/bundle "), number, F.lit(" FLAT")))
        .when(n < 800, "/searcharchive word 99")
        .otherwise(F.col("text"))
    )
    return t.conversations.select("conv_id", "turn", "text", message.alias("message"))


@query(
    "parse_command",
    f"""
SELECT conv_id, turn, CASE WHEN length(text) < 200 THEN 'archiveask' WHEN length(text) < 400 THEN 'tenderprice' WHEN length(text) < 600 THEN 'bundle'
    WHEN length(text) < 800 THEN 'archivesearch' END AS name,
  CASE WHEN length(text) < 200 THEN {sql_trim("text || ' 12'")} WHEN length(text) < 400 THEN {sql_trim("(conv_id + 10000) || ' 2024 ' || text")}
    WHEN length(text) < 600 THEN (conv_id + 10000) || ' FLAT' WHEN length(text) < 800 THEN 'word 99' END AS rest FROM conversations
""",
)
def _command(t: Tables) -> DataFrame:
    parsed = command_messages(t).select("conv_id", "turn", mx.parse_command(F.col("message")).alias("c"))
    return parsed.select("conv_id", "turn", "c.name", "c.rest")


@query(
    "parse_topk",
    f"""
SELECT conv_id, turn, CASE WHEN length(text) < 200 THEN {sql_collapse('text')} ELSE 'word' END AS query_text, CASE WHEN length(text) < 200 THEN 12 ELSE 24 END AS k
FROM conversations WHERE length(text) < 200 OR length(text) BETWEEN 600 AND 799
""",
)
def _topk(t: Tables) -> DataFrame:
    parsed = command_messages(t).select("conv_id", "turn", mx.parse_command(F.col("message")).alias("c")).where("c.name LIKE 'archive%'")
    return parsed.select("conv_id", "turn", mx.parse_topk(F.col("c.rest")).alias("q")).select("conv_id", "turn", "q.query_text", "q.k")


@query(
    "parse_tender_args",
    f"""
SELECT conv_id, turn, CAST(conv_id + 10000 AS VARCHAR) AS tender_id, CASE WHEN length(text) < 400 THEN '2024' END AS year, length(text) >= 400 AS flat,
  CASE WHEN length(text) < 400 THEN {sql_collapse('text')} ELSE '' END AS tail, length(text) < 400 AS has_price FROM conversations WHERE length(text) BETWEEN 200 AND 599
""",
)
def _args(t: Tables) -> DataFrame:
    parsed = command_messages(t).select("conv_id", "turn", mx.parse_command(F.col("message")).alias("c")).where("c.name IN ('tenderprice', 'bundle')")
    rest = F.col("c.rest")
    rows = parsed.select("conv_id", "turn", mx.parse_tender_args(rest).alias("a"), mx.parse_price_args(rest).isNotNull().alias("has_price"))
    return rows.select("conv_id", "turn", "a.*", "has_price")


# Intents: the beginning of a message follows from its role and length.
_SQL_INTENT_TEXT = """CASE WHEN length(text) < 200 THEN '@my_bot  Спасибо, ' || substring(text, 1, 40) WHEN length(text) < 300 THEN 'Кто ты?' WHEN length(text) < 400 THEN 'Помоги найти'
  WHEN length(text) < 500 THEN 'Привет!' WHEN length(text) < 600 THEN 'Спасибо за тендер' WHEN length(text) < 700 THEN 'Что умеешь' WHEN length(text) < 800 THEN 'пока.' ELSE text END"""


def _intent_text() -> Column:
    n = F.length("text")
    return (
        F.when(n < 200, F.concat(F.lit("@my_bot  Спасибо, "), F.substring("text", 1, 40))).when(n < 300, "Кто ты?").when(n < 400, "Помоги найти")
        .when(n < 500, "Привет!").when(n < 600, "Спасибо за тендер").when(n < 700, "Что умеешь").when(n < 800, "пока.").otherwise(F.col("text"))
    )


@query(
    "intent",
    """
SELECT conv_id, turn, CASE WHEN n < 200 THEN 'thanks' WHEN n < 300 THEN 'identity' WHEN n < 400 THEN 'capabilities' WHEN n < 500 THEN NULL WHEN n < 600 THEN NULL
  WHEN n < 700 THEN 'capabilities' WHEN n < 800 THEN 'bye' END AS intent, n BETWEEN 400 AND 499 AS greeting FROM (SELECT *, length(text) AS n FROM conversations)
""",
)
def _intent(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", mx.intent(_intent_text()).alias("intent"), mx.is_greeting(_intent_text()).alias("greeting"))


@query(
    "view_ids",
    f"""
SELECT conv_id, turn, CASE WHEN n < 300 THEN CAST(conv_id + 1000000 AS VARCHAR) WHEN n < 600 THEN CAST(turn + 7000000 AS VARCHAR) WHEN n < 900 THEN CAST(conv_id AS VARCHAR) END AS view_id,
  n < 900 AS import, CASE WHEN n < 300 THEN 2 ELSE 0 END::BIGINT AS n_links FROM (SELECT *, length(text) AS n FROM conversations)
""",
)
def _view_ids(t: Tables) -> DataFrame:
    """Short messages hold two card addresses, longer ones a numbered tender, then a bare number; the rest are as given."""
    n = F.length("text")
    first = (F.col("conv_id") + 1_000_000).cast("string")
    message = (
        F.when(n < 300, F.concat("text", F.lit(f" https://www.{VIEW_URL}"), first, F.lit(f" {VIEW_URL}5 "), F.lit(VIEW_URL), first))
        .when(n < 600, F.concat(F.lit("Начинаем тендер № "), (F.col("turn") + 7_000_000).cast("string")))
        .when(n < 900, F.col("conv_id").cast("string"))
        .otherwise(F.col("text"))
    )
    return t.conversations.select(
        "conv_id", "turn", mx.resolve_view_id(message, VIEW_URL).alias("view_id"), mx.should_import(message, VIEW_URL).alias("import"),
        F.size(urls.view_ids(message, VIEW_URL)).cast("bigint").alias("n_links"),
    )


@query(
    "starts_with_other_mention",
    """
SELECT conv_id, turn, role <> 'system' AND (role = 'user' OR length(text) < 500) AND NOT (role = 'user' AND length(text) >= 700) AS other FROM conversations
""",
)
def _mention(t: Tables) -> DataFrame:
    """User messages begin with a mention entity of a colleague or of the bot, assistant ones with a plain mention."""
    n, role = F.length("text"), F.col("role")
    own = F.when(role == "user", n >= 700).otherwise(n >= 500)
    body = F.concat(F.lit("  "), F.when(own, "@my_bot").otherwise("@colleague"), F.lit(" "), "text")
    entity = F.struct(F.lit("mention").alias("type"), F.lit(2).alias("offset"), F.when(own, 7).otherwise(10).alias("length"), F.lit(None).cast("bigint").alias("user_id"))
    entities = F.when(role == "user", F.array(entity))
    chat = F.when(role == "system", "private").otherwise("group")
    other = mx.starts_with_other_mention(body, chat, entities, "my_bot", 1)
    return t.conversations.select("conv_id", "turn", other.alias("other"))


def chat_messages(t: Tables) -> DataFrame:
    """Conversations as updates: system turns come from channels, long user turns from groups."""
    n, role = F.length("text"), F.col("role")
    none = F.lit(None).cast("array<struct<type:string,offset:int,length:int,user_id:bigint>>")
    return t.conversations.select(
        "conv_id",
        F.col("turn").alias("message_id"),
        F.when(role == "system", "channel").when(n > 800, "group").otherwise("private").alias("chat_type"),
        F.when(n < 150, "/newchat").when(n < 250, "/ask что умеешь").when(n < 350, "Импорт тендера № 1234567").when(n < 450, "Спасибо!").when(n < 550, "Добрый день")
        .otherwise(F.col("text")).alias("text"),
        F.lit(None).cast("string").alias("caption"),
        none.alias("entities"),
        (F.col("turn") > 3).alias("reply_to_bot"),
        ((n >= 550) & (n < 600)).alias("gate_open"),
        (F.col("turn") > 1).alias("has_history"),
    )


_SQL_ROUTE = """
SELECT conv_id, turn AS message_id, CASE WHEN role = 'system' THEN 'skip' WHEN n BETWEEN 550 AND 599 THEN 'gate' WHEN n < 150 THEN 'command:newchat' WHEN n < 250 THEN 'conversation'
  WHEN n < 350 THEN 'import' WHEN n < 450 THEN 'conversation' WHEN n < 550 AND turn <= 1 THEN 'greeting' WHEN n > 800 AND turn <= 3 AND NOT regexp_matches(text, '(^|[^\\pL\\pN_])\\d{6,10}($|[^\\pL\\pN_])') THEN 'hint' ELSE 'ask' END AS route
FROM (SELECT *, length(text) AS n FROM conversations)"""


@query("route_updates", _SQL_ROUTE)
def _route(t: Tables) -> DataFrame:
    return ms.route_updates(chat_messages(t), "my_bot", 1, VIEW_URL).select("conv_id", "message_id", "route")


@query(
    "consume_once",
    """
SELECT user_id, event_type, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1
""",
)
def _once(t: Tables) -> DataFrame:
    events = t.events.select("user_id", "event_type", "ts", "event_id")
    return ms.consume_once(events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query(
    "pending_ttl",
    """
SELECT user_id, count(*) AS n_touches, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session
""",
)
def _ttl(t: Tables) -> DataFrame:
    sessions = ms.pending_sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id")
    return sessions.select("user_id", "n_touches", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"))


@query(
    "updates_stream",
    "SELECT event_type, count(*) AS n, max(event_id) + 1 AS next_offset FROM events GROUP BY 1",
)
def _updates(t: Tables) -> DataFrame:
    """The table as a stream of files, drained: each batch leaves its counts and last update, as one that polls would."""
    out = f"{shared_folder(t.spark)}/updates-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        counts = batch.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
        counts.write.mode("overwrite").parquet(f"{out}/counts/epoch={epoch}")

    stream = t.stream("events").select("event_type", "event_id").writeStream.foreachBatch(keep)
    stream.option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start().awaitTermination()
    batches = t.spark.read.parquet(f"{out}/counts")
    return batches.groupBy("event_type").agg(F.sum("n").alias("n"), (F.max("last") + 1).alias("next_offset"))


@query(
    "read_updates",
    "SELECT event_type AS text, count(*) AS n, count(DISTINCT event_id) AS n_distinct, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1",
)
def _read_updates(t: Tables) -> DataFrame:
    """The table as a log that is polled twice: up to the middle, and by a restart that goes on from there."""
    out = f"{shared_folder(t.spark)}/update-log-{uuid.uuid4().hex}"
    known = {"update_id": F.col("event_id"), "chat_id": F.col("user_id"), "text": F.col("event_type"), "ts": F.col("ts").cast("timestamp")}
    fields = T.StructType.fromDDL(readers.UPDATE_SCHEMA).fields
    sinks.write_update_log(t.events.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]), f"{out}/log")
    middle = t.events.agg(F.expr("(min(event_id) + max(event_id)) div 2")).first()[0]
    for until in (middle, None):
        updates = readers.read_updates(t.spark, f"{out}/log", until=until)
        sink = updates.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/offsets")
        sink.trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.schema(readers.UPDATE_SCHEMA).parquet(f"{out}/rows")
    return rows.groupBy("text").agg(
        F.count("*").alias("n"), F.countDistinct("update_id").alias("n_distinct"), F.min("update_id").alias("first_id"), F.max("update_id").alias("last_id")
    )


@query(
    "reply_to_anchor",
    """
SELECT u.conv_id AS chat_id, u.turn AS message_id, 'k' || a.turn AS token FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn - 1
WHERE u.role = 'user' AND a.role = 'assistant'
""",
)
def _anchor(t: Tables) -> DataFrame:
    """A user's turn replies to the turn before it; only an assistant's turn is an open question."""
    rows = t.conversations
    replies = rows.where("role = 'user'").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("message_id"), (F.col("turn") - 1).alias("reply_to"))
    phase = F.when(F.col("role") == "assistant", "awaiting").otherwise("ready")
    token = F.concat(F.lit("k"), F.col("turn").cast("string"))
    anchors = rows.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("message_id"), phase.alias("phase"), token.alias("token"))
    return ms.reply_to_anchor(replies, anchors, "awaiting").select("chat_id", "message_id", "token")


@query(
    "terms_wizard",
    f"""
SELECT conv_id, max(CASE WHEN n = 1 THEN {sql_trim('text')} END) AS price, max(CASE WHEN n = 2 THEN {sql_trim('text')} END) AS payment,
  max(CASE WHEN n = 3 THEN {sql_trim('text')} END) AS delivery, max(CASE WHEN n = 4 THEN {sql_trim('text')} END) AS warranty, max(n) = 4 AS ready
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') WHERE n <= 4 GROUP BY 1
""",
)
def _wizard(t: Tables) -> DataFrame:
    return ms.terms_wizard(t.conversations.where("role = 'user'"), "conv_id", "turn", "text")


@query(
    "callback_state",
    """
SELECT user_id, g.event_id AS go_at, s.choice AS selected, CASE WHEN s.choice IS NULL THEN 'nothing_selected' ELSE 'accepted' END AS outcome, n - 1 AS n_repeated
FROM (SELECT user_id, min(event_id) AS event_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) g LEFT JOIN (
  SELECT c.user_id, arg_max(CASE WHEN c.value > 10 THEN 1 ELSE 0 END, c.event_id) AS choice FROM events c JOIN (
    SELECT user_id, min(event_id) AS at FROM events WHERE event_type = 'purchase' GROUP BY 1) f ON f.user_id = c.user_id AND c.event_id < f.at
  WHERE c.event_type = 'click' GROUP BY 1) s USING (user_id)
""",
)
def _callback(t: Tables) -> DataFrame:
    action = F.when(F.col("event_type") == "click", "select").when(F.col("event_type") == "purchase", "go")
    events = t.events.select("user_id", "event_id", action.alias("action"), F.when(F.col("value") > 10, 1).otherwise(0).alias("option"))
    return ms.callback_outcomes(events.where("action IS NOT NULL"), "user_id", "event_id", "action", "option")


# Flows: a user's events are the presses and replies of one token; every seventeenth event starts it anew.
_HINTS = {
    "price": ("e % 2 = 0", "цена лота 100 BYN", "short"), "payment": ("e % 3 = 0", "Предоплата 30 % в течение 10 дней", "оплата как обычно у нас"),
    "delivery": ("e % 4 <> 0", "срок 20 календарных дней", ""), "warranty": ("e % 5 < 2", "Гарантийный срок 24 месяца", "гарантия у нас хорошая"),
}
_SQL_FLOW = f"""
WITH RECURSIVE ev AS (
  SELECT *, row_number() OVER (PARTITION BY u ORDER BY e) AS n FROM (
    SELECT event_id AS e, user_id AS u, event_id * 8 AS sec, CASE WHEN event_id % 23 = 0 THEN user_id + 1000 ELSE user_id END AS chat,
      CASE WHEN event_id % 17 = 0 THEN 'start' WHEN event_type = 'click' OR (event_type = 'signup' AND event_id % 5 <> 0) THEN 'reply' WHEN event_type = 'signup' THEN 'own'
           WHEN event_type = 'view' THEN 'starter' WHEN event_type = 'purchase' THEN 'go' ELSE 'select' END AS action,
      CASE WHEN event_id % 13 = 0 THEN '/cmd' WHEN event_id % 19 = 0 THEN '' ELSE event_type || ' ' || event_id END AS body,
      event_id % 4 AS slot, CASE WHEN event_id % 29 <> 0 THEN event_id % 4 END AS opt,
      [{", ".join(f"CASE WHEN {sql.replace('e %', 'event_id %')} THEN '{good}' END" for sql, good, _ in _HINTS.values())}] AS hints FROM events)),
s AS (
  SELECT u, 0::BIGINT AS n, NULL::BIGINT AS e, NULL::VARCHAR AS outcome, false AS live, NULL::BIGINT AS chat, 0 AS step, 0::BIGINT AS touched, NULL::INTEGER AS selected, false AS consumed,
    []::VARCHAR[] AS hints, []::VARCHAR[] AS slots, []::VARCHAR[] AS origins FROM (SELECT DISTINCT u FROM ev)
  UNION ALL
  SELECT u, n, e, o, CASE o WHEN 'started' THEN true WHEN 'expired' THEN false ELSE live END, CASE WHEN o = 'started' THEN new_chat ELSE chat END,
    CASE WHEN o IN ('started', 'expired') THEN 0 WHEN o IN ('accepted', 'ready') THEN step + 1 ELSE step END,
    CASE WHEN o IN ('started', 'accepted', 'ready', 'own_wanted', 'selected') THEN sec ELSE touched END,
    CASE WHEN o IN ('started', 'expired') THEN NULL WHEN o = 'selected' THEN opt ELSE selected END::INTEGER,
    CASE WHEN o = 'started' THEN false WHEN o = 'go' THEN true ELSE consumed END,
    CASE WHEN o = 'started' THEN new_hints ELSE hints END,
    CASE WHEN o IN ('started', 'expired') THEN [] WHEN o IN ('accepted', 'ready') THEN list_append(slots, CASE WHEN action = 'reply' THEN body ELSE hint END) ELSE slots END,
    CASE WHEN o IN ('started', 'expired') THEN [] WHEN o IN ('accepted', 'ready') THEN list_append(origins, CASE WHEN action = 'reply' THEN 'manager' ELSE 'documents' END) ELSE origins END
  FROM (SELECT *, CASE WHEN action = 'start' THEN 'started' WHEN NOT live THEN 'expired' WHEN chat <> new_chat THEN 'unknown' WHEN sec - touched > 3600 THEN 'expired'
      WHEN action IN ('reply', 'starter', 'own') THEN CASE WHEN step >= 4 THEN 'not_waiting' WHEN action <> 'reply' AND slot <> step THEN 'stale_step' WHEN action = 'own' THEN 'own_wanted'
        WHEN action = 'starter' AND hint IS NULL THEN 'no_hint' WHEN action = 'reply' AND (body = '' OR body LIKE '/%') THEN 'ignored' WHEN step = 3 THEN 'ready' ELSE 'accepted' END
      WHEN step < 4 THEN 'gate_not_ready' WHEN action = 'select' THEN CASE WHEN opt IS NULL OR opt > 1 THEN 'ignored' ELSE 'selected' END
      WHEN consumed THEN 'already_consumed' WHEN selected IS NULL THEN 'nothing_selected' ELSE 'go' END AS o
    FROM (SELECT s.*, ev.n AS new_n, ev.e AS new_e, ev.sec, ev.chat AS new_chat, ev.action, ev.body, ev.slot, ev.opt, ev.hints AS new_hints, s.hints[s.step + 1] AS hint
          FROM s JOIN ev ON ev.u = s.u AND ev.n = s.n + 1) AS j) AS k)
SELECT 'k' || u AS token, e AS update_id, outcome, CASE WHEN live THEN ['price', 'payment', 'delivery', 'warranty'][step + 1] END AS step, selected, slots[1] AS price, slots[2] AS payment,
  slots[3] AS delivery, slots[4] AS warranty, array_to_string(origins, ',') AS origins FROM s WHERE n > 0""".replace("SELECT u, n, e, o,", "SELECT u, new_n, new_e, o,")


def wizard_events(events: DataFrame) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    action = (
        F.when(e % 17 == 0, "start").when((kind == "click") | ((kind == "signup") & (e % 5 != 0)), "reply").when(kind == "signup", "own")
        .when(kind == "view", "starter").when(kind == "purchase", "go").otherwise("select")
    )
    body = F.when(e % 13 == 0, "/cmd").when(e % 19 == 0, "  ").otherwise(F.concat(F.lit(" "), kind, F.lit(" "), e.cast("string")))
    hints = {slot: F.when(F.expr(sql.replace("e %", "event_id %")), good).otherwise(bad) for slot, (sql, good, bad) in _HINTS.items()}
    return events.select(
        F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("token"), e.alias("update_id"), F.when(e % 23 == 0, F.col("user_id") + 1000).otherwise(F.col("user_id")).alias("chat_id"),
        action.alias("action"), F.when(action == "reply", body).alias("text"), F.element_at(F.array(*map(F.lit, ms.WIZARD_STEPS)), (e % 4 + 1).cast("int")).alias("step"),
        F.when(e % 29 != 0, e % 4).cast("int").alias("option"), F.when(action == "start", flows.qualified_hints(hints)).alias("hints"), F.timestamp_seconds(e * 8 + 1_700_000_000).alias("ts"),
    )


def _flow_rows(outcomes: DataFrame) -> DataFrame:
    origins = F.concat_ws(",", *[F.col("origins")[s] for s in ms.WIZARD_STEPS])
    return outcomes.select("token", "update_id", "outcome", "step", "selected", *ms.WIZARD_STEPS, origins.alias("origins"))


@query("terms_flow", _SQL_FLOW)
def _terms_flow(t: Tables) -> DataFrame:
    """The wizard's stream over the events, drained: typed state and a timer for every token."""
    out = f"{shared_folder(t.spark)}/terms-{uuid.uuid4().hex}"
    with rocksdb_state(t.spark):
        outcomes = flows.terms_flow(wizard_events(t.stream("events")))
        sink = outcomes.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
        sink.trigger(availableNow=True).start().awaitTermination()
    return _flow_rows(t.spark.read.schema(outcomes.schema).parquet(f"{out}/rows"))


@query("terms_flow_replay", _SQL_FLOW)
def _terms_replay(t: Tables) -> DataFrame:
    """The same outcomes from the table."""
    return _flow_rows(flows.replay_terms(wizard_events(t.events)))


@query(
    "message_parts",
    """
SELECT doc_id, i AS part, CASE WHEN i > 0 THEN '(продолжение ' || (i + 1) || ')' || chr(10) ELSE '' END || substring(text, i * 3800 + 1, 3800) AS body
FROM documents, LATERAL (SELECT unnest(range(0, CAST(ceil(length(text) / 3800.0) AS BIGINT))) AS i)
""",
)
def _parts(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(mx.message_parts(F.col("text"))).alias("part", "body"))
    return rows.withColumn("part", F.col("part").cast("bigint"))
