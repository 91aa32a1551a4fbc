"""Streams drained over the same rows give what their batch twins give."""

import pytest
from pyspark.sql import functions as F

from docsluice.operators import messages as ms
from docsluice.streaming import flows, updates

TABLES = "/root/testdata/sf0.001"


def drain(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name))
    q.trigger(availableNow=True).start().awaitTermination(120)
    return stream.sparkSession.table(name)


@pytest.fixture(scope="module")
def turns(spark):
    return spark.read.parquet(f"{TABLES}/conversations.parquet")


def stream_of(spark, df, tmp_path, name):
    path = str(tmp_path / f"in-{name}")
    df.coalesce(1).write.json(path)
    return spark.readStream.schema(df.schema).json(path)


def event(spark, df, action, update_id, text):
    none = F.lit(None)
    return df.select(
        F.col("conv_id").cast("string").alias("token"), update_id.alias("update_id"), F.col("conv_id").alias("chat_id"),
        F.lit(action).alias("action"), text.alias("text"), none.cast("string").alias("step"), none.cast("int").alias("option"),
        F.timestamp_seconds(F.lit(1_700_000_000) + update_id * 60).alias("ts"),
    )


def test_wizard_stream_equals_batch(spark, turns, tmp_path):
    replies = turns.where("role = 'user' AND NOT startswith(text, '/')")
    start = event(spark, turns.select("conv_id").distinct(), "start", F.lit(0).cast("bigint"), F.lit(""))
    events = start.unionByName(event(spark, replies, "reply", F.col("turn") + 1, F.col("text")))
    out = drain(flows.terms_flow(stream_of(spark, events, tmp_path, "wizard")), tmp_path, "wizard_out")
    ready = {(r["token"], r["price"], r["warranty"]) for r in out.where("outcome = 'ready'").collect()}
    batch = ms.terms_wizard(replies, "conv_id", "turn", "text").where("ready")
    assert ready == {(str(r["conv_id"]), r["price"], r["warranty"]) for r in batch.collect()} and ready


def test_history_stream_equals_batch(spark, turns, tmp_path):
    rows = turns.select(F.col("conv_id").alias("chat_id"), "turn", "role", "text", (F.length("text") < 120).alias("is_reset"))
    out = drain(flows.rolling_history(stream_of(spark, rows, tmp_path, "history")), tmp_path, "history_out", "update")
    batch = ms.history_after_reset(turns, "conv_id", "turn", F.length("text") < 120)
    assert {(r["chat_id"], r["turn"]) for r in out.collect()} == {(r["conv_id"], r["turn"]) for r in batch.collect()}


def test_tokens_are_consumed_once(spark, tmp_path):
    events = spark.read.parquet(f"{TABLES}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    twice = events.unionByName(events)
    out = drain(updates.consume_once(stream_of(spark, twice, tmp_path, "once"), ["event_id"]), tmp_path, "once_out")
    assert out.count() == events.count()


def test_numbers_are_given_once(spark, tmp_path):
    write = updates.number_documents(str(tmp_path / "numbers"), "id")
    first, second = spark.range(0, 10), spark.range(10, 25)
    write(first, 0)
    write(second, 1)
    write(second, 1)
    serials = [r["serial"] for r in spark.read.parquet(str(tmp_path / "numbers")).orderBy("id").collect()]
    assert serials == list(range(1, 26))


def test_buttons():
    base = {"chat_id": 1, "at_ms": 0}
    state, said = flows.advance(None, {**base, "action": "start"})
    assert said == "started" and flows.advance(state, {**base, "action": "go"})[1] == "gate_not_ready"
    for slot in ("price", "payment", "delivery", "warranty"):
        assert flows.advance(state, {**base, "action": "starter", "step": "other", "text": "x"})[1] == "stale_step"
        state, said = flows.advance(state, {**base, "action": "starter", "step": slot, "text": " value "})
    assert said == "ready" and state["warranty"] == "value"
    assert flows.advance(state, {**base, "action": "go"})[1] == "nothing_selected"
    assert flows.advance(state, {**base, "action": "select", "option": 2})[1] == "ignored"
    assert flows.advance(state, {**base, "chat_id": 2, "action": "select", "option": 1})[1] == "unknown"
    state, said = flows.advance(state, {**base, "action": "select", "option": 1})
    assert flows.advance(state, {**base, "action": "go", "at_ms": 3_600_001})[1] == "expired"
    state, said = flows.advance(state, {**base, "action": "go"})
    assert said == "go" and flows.advance(state, {**base, "action": "go"})[1] == "already_consumed"


def test_routes_and_sessions_stream(spark, turns, tmp_path):
    none = F.lit(None).cast("array<struct<type:string,offset:int,length:int,user_id:bigint>>")
    rows = turns.select(
        F.col("conv_id"), F.col("turn").alias("message_id"), F.lit("private").alias("chat_type"), "text",
        F.lit(None).cast("string").alias("caption"), none.alias("entities"), F.lit(False).alias("reply_to_bot"),
    )
    url = "portal.example.com/view/"
    out = drain(updates.route_stream(stream_of(spark, rows, tmp_path, "route"), "bot", 1, url), tmp_path, "route_out")
    known = rows.withColumns({"gate_open": F.lit(False), "has_history": F.lit(False)})
    batch = ms.route_updates(known, "bot", 1, url)
    pick = lambda df: {(r["conv_id"], r["message_id"], r["route"]) for r in df.collect()}
    assert pick(out) == pick(batch)


def test_lifetime_holds_for_replies():
    base = {"chat_id": 1, "at_ms": 0}
    state, _ = flows.advance(None, {**base, "action": "start"})
    late = {**base, "action": "reply", "text": "x", "at_ms": 11 * 86_400_000}
    assert flows.advance(state, late) == (None, "expired")


def test_busy_key_has_the_same_sessions_in_both_ways(spark):
    at = [0, 10, 3600, 3601, 7201, 10802, 20000, 23600, 27201]
    rows = spark.createDataFrame([(u, s) for u in ("a", "b") for s in at], "u string, s long").select("u", F.timestamp_seconds("s").alias("ts"))
    got = {(r["u"], r["n_touches"], r["first"], r["last"]) for r in ms.pending_sessions(rows, "u").collect()}
    gap = F.session_window("ts", "3600 seconds 1 milliseconds")
    want = rows.groupBy("u", gap).agg(F.count("*").alias("n"), F.min("ts").alias("f"), F.max("ts").alias("l"))
    assert got == {(r["u"], r["n"], r["f"], r["l"]) for r in want.collect()}


def wizard_rows(spark):
    from docsluice.plans.message_queries import wizard_events

    return wizard_events(spark.read.parquet(f"{TABLES}/events.parquet")).orderBy("ts")


def outcomes(df):
    return sorted((r["token"], r["update_id"], r["outcome"], r["step"], r["selected"], r["price"], r["warranty"], tuple(sorted((r["origins"] or {}).items()))) for r in df.collect())


def test_wizard_over_many_batches_equals_the_replay(spark, tmp_path):
    rows = wizard_rows(spark).collect()
    schema, path = wizard_rows(spark).schema, tmp_path / "in-many"
    for k in range(4):  # a batch for each file, in order of time
        part = rows[len(rows) * k // 4 : len(rows) * (k + 1) // 4]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    got = outcomes(drain(flows.terms_flow(stream), tmp_path, "wizard_many"))
    want = outcomes(flows.replay_terms(spark.createDataFrame(rows, schema)))
    assert got == want
    assert {r[2] for r in want} == {
        "started", "accepted", "ready", "expired", "unknown", "not_waiting", "stale_step", "own_wanted", "no_hint", "ignored", "gate_not_ready", "selected", "go",
        "already_consumed", "nothing_selected",
    }


def test_hints_that_may_fill_a_slot(spark):
    cases = {"price": "цена лота 100 BYN", "payment": "Предоплата 30 % в течение 10 дней", "delivery": "коротко", "warranty": "гарантия у нас хорошая"}
    got = spark.range(1).select(flows.qualified_hints({s: F.lit(h) for s, h in cases.items()}).alias("h"), flows.qualified_hints({"price": F.lit(None).cast("string")}).alias("n")).first()
    assert got["h"] == {"price": cases["price"], "payment": cases["payment"]} and got["n"] == {}


def test_log_is_polled_from_where_it_was_left(spark, tmp_path):
    from docsluice.sources import readers, sinks

    def updates(first, stop):
        rows = spark.range(first, stop).withColumnRenamed("id", "update_id")
        return rows.select(*[F.col(f.name) if f.name == "update_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], readers.UPDATE_SCHEMA).schema])

    def poll(until=None, name="rows"):
        q = readers.read_updates(spark, str(tmp_path / "log"), 5, until).writeStream.format("parquet").option("path", str(tmp_path / name))
        q.option("checkpointLocation", str(tmp_path / f"{name}-offsets")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r["update_id"] for r in spark.read.schema(readers.UPDATE_SCHEMA).parquet(str(tmp_path / name)).collect())

    sinks.write_update_log(updates(0, 25_000), str(tmp_path / "log"))
    assert poll(until=12_000) == list(range(5, 12_000))
    assert poll(until=12_000) == list(range(5, 12_000))
    assert poll() == list(range(5, 25_000))
    sinks.write_update_log(updates(25_000, 25_300), str(tmp_path / "log"))
    assert poll() == list(range(5, 25_300))
    reader = __import__("docsluice.sources.datasources", fromlist=["x"]).UpdateLogReader({"path": str(tmp_path / "log")}, updates(0, 1).schema)
    ids = lambda: sorted(i for p in reader.partitions({"next": 9_990}, {"next": 20_010}) for b in reader.read(p) for i in b["update_id"].to_pylist())
    assert ids() == ids() == list(range(9_990, 20_010)) and len(reader.partitions({"next": 9_990}, {"next": 20_010})) == 3
    assert reader.partitions({"next": 20_010}, {"next": 20_010}) == []


def test_state_store_setting_comes_back(spark):
    from docsluice.session import STATE_STORE, rocksdb_state

    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "other")
    try:
        with rocksdb_state(spark):
            assert "RocksDB" in spark.conf.get(STATE_STORE)
        assert spark.conf.get(STATE_STORE) == "other"
    finally:
        spark.conf.set(STATE_STORE, before)
