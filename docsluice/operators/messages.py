"""Message jobs on tables: routing, whitelists, histories, sessions, and the batch twins of the stateful streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.functions import messages as mx
from docsluice.functions import text as tx

# History length, lifetime of pending flows, and wizard steps.
HISTORY_MESSAGES = 10
PENDING_MINUTES = 60
WIZARD_STEPS = ("price", "payment", "delivery", "warranty")
ORGANISATIONS = 2


def allowed_chats(updates: DataFrame, chats: DataFrame, key: str = "chat_id") -> DataFrame:
    """Updates of listed chats; an empty list allows all."""
    return updates if chats.isEmpty() else updates.join(chats.select(key).distinct(), key, "left_semi")



def route_updates(messages: DataFrame, bot: str, bot_id: int, view_url: str, nfc: bool = True) -> DataFrame:
    """Add ``body`` and ``route``.

    messages: chat_type, message_id, text, caption, entities, reply_to_bot, gate_open (a reply to an open question),
    has_history.  Routes: skip, gate, command:<name>, import, conversation, greeting, hint, ask.
    """
    body = tx.clean_message(F.coalesce(F.nullif("text", F.lit("")), "caption", F.lit("")), nfc)
    step = messages.withColumn("body", body)
    step = step.withColumn("_command", mx.parse_command(F.col("body")))
    b, command = F.col("body"), F.col("_command")
    group = F.col("chat_type").isin("group", "supergroup")
    lost = group & ~mx.has_context(b, F.col("reply_to_bot"), view_url)
    skip = (
        (b == "") | ~F.col("chat_type").isin("private", "group", "supergroup") | F.col("message_id").isNull()
        | mx.starts_with_other_mention(b, F.col("chat_type"), F.col("entities"), bot, bot_id)
    )
    free = (
        F.when(mx.should_import(b, view_url), "import")
        .when(mx.intent(b).isNotNull(), "conversation")
        .when(~F.col("has_history") & mx.is_greeting(b), "greeting")
        .when(lost, "hint")
        .otherwise("ask")
    )
    rest = command["rest"]
    ordered = (
        F.when((rest != "") & mx.intent(rest).isNotNull(), "conversation")
        .when(
            (command["name"] == "ask") & group & (rest != "") & ~mx.has_context(rest, F.col("reply_to_bot"), view_url), "hint"
        )
        .when(command["name"].isin(*mx.COMMANDS), F.concat(F.lit("command:"), command["name"]))
        .otherwise("skip")
    )
    route = (
        F.when(skip, "skip").when(F.col("gate_open") & ~b.startswith("/"), "gate").when(command.isNotNull(), ordered).otherwise(free)
    )
    return step.withColumn("route", route).drop("_command")


def rolling_history(turns: DataFrame, chat: str, order: str, limit: int = HISTORY_MESSAGES) -> DataFrame:
    """The last messages per chat; the rank is cut before the shuffle, so a long chat sends only its end."""
    w = Window.partitionBy(chat).orderBy(F.desc(order))
    last = turns.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return last.drop("n")


def history_after_reset(turns: DataFrame, chat: str, order: str, is_reset: Column, limit: int = HISTORY_MESSAGES) -> DataFrame:
    """The last messages after a chat's latest reset: a maximum per chat, not a running count."""
    marked = turns.withColumn("_reset", is_reset)
    resets = marked.where("_reset").groupBy(chat).agg(F.max(order).alias("_at"))
    joined = marked.where("NOT _reset").join(resets, chat, "left")
    after = joined.where(F.col("_at").isNull() | (F.col(order) > F.col("_at")))
    return rolling_history(after.drop("_reset", "_at"), chat, order, limit)


def consume_once(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first event per token."""
    others = [c for c in events.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *others))
    return events.groupBy(*keys).agg(first.alias("_f")).select(*keys, *[f"_f.{c}" for c in (*order, *others)])


def pending_sessions(events: DataFrame, key: str, ts: str = "ts", minutes: int = PENDING_MINUTES) -> DataFrame:
    """Lifetimes of pending flows: touches no more than the lifetime apart.

    Touches within one stretch of the lifetime's length always belong together, so a busy key is first combined per
    stretch, before the shuffle, and only its stretches are put in order.
    """
    stretch = F.floor(F.unix_micros(ts) / F.lit(minutes * 60_000_000)).alias("stretch")
    spans = events.groupBy(key, stretch).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    w = Window.partitionBy(key).orderBy("stretch")
    apart = F.unix_micros("first") - F.lag(F.unix_micros("last")).over(w) > minutes * 60_000_000
    runs = spans.withColumn("fresh", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("session", F.sum("fresh").over(w))
    return runs.groupBy(key, "session").agg(
        F.sum("n").alias("n_touches"), F.min("first").alias("first"), F.max("last").alias("last")
    ).drop("session")


def reply_to_anchor(replies: DataFrame, anchors: DataFrame, phase: str) -> DataFrame:
    """Replies ⋈ open questions on (chat, message), only where the question is in the phase."""
    open_ones = anchors.where(F.col("phase") == phase).select("chat_id", F.col("message_id").alias("reply_to"), "token")
    return replies.join(open_ones, ["chat_id", "reply_to"])


def terms_wizard(replies: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The first four replies per flow as slots; ready with the fourth."""
    w = Window.partitionBy(key).orderBy(order)
    first = replies.withColumn("n", F.row_number().over(w)).where(F.col("n") <= len(WIZARD_STEPS))
    slots = [F.max(F.when(F.col("n") == i + 1, tx.js_trim(F.col(text)))).alias(s) for i, s in enumerate(WIZARD_STEPS)]
    return first.groupBy(key).agg(*slots, (F.max("n") == len(WIZARD_STEPS)).alias("ready"))


def callback_outcomes(events: DataFrame, key: str, order: str, action: str, option: str) -> DataFrame:
    """What the first ``go`` per flow meets: the last selection before it, or the reason it is refused."""
    go = events.where(F.col(action) == "go").groupBy(key).agg(F.min(order).alias("go_at"), F.count("*").alias("n_go"))
    select = events.where(F.col(action) == "select").join(go.select(key, "go_at"), key).where(F.col(order) < F.col("go_at"))
    chosen = select.groupBy(key).agg(F.max_by(option, order).alias("selected"))
    out = go.join(chosen, key, "left")
    state = F.when(F.col("selected").isNull(), "nothing_selected").otherwise("accepted")
    return out.select(key, "go_at", "selected", state.alias("outcome"), (F.col("n_go") - 1).alias("n_repeated"))
