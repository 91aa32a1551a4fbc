"""Per-token and per-chat state: the terms wizard with its buttons, and rolling histories.

The steps are small functions over one event; Spark keys, orders and stores the state around them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docsluice.functions import text as tx
from docsluice.operators import policy
from docsluice.operators.messages import HISTORY_MESSAGES, ORGANISATIONS, PENDING_MINUTES, WIZARD_STEPS

_TTL_MS = PENDING_MINUTES * 60_000
FROM_MANAGER, FROM_DOCUMENTS = "manager", "documents"
_EVENT = ("token", "update_id", "chat_id", "action", "text", "step", "option", "hints", "ts")
_OUT = (
    "token string, update_id bigint, outcome string, step string, selected int, price string, payment string, delivery string, "
    "warranty string, origins map<string,string>"
)


def qualified_hints(hints: dict[str, Column]) -> Column:
    """A map of those hints that may fill a slot: long enough, and payment and warranty with concrete terms."""
    def fits(slot: str, hint: Column) -> Column:
        judged = {"payment": policy.concrete_payment, "warranty": policy.concrete_warranty}
        return judged[slot](hint) if slot in judged else F.length(tx.js_trim(hint)) >= policy.MIN_HINT

    pairs = [F.when(F.coalesce(fits(s, h), F.lit(False)), F.struct(F.lit(s).alias("k"), tx.js_trim(h).alias("v"))) for s, h in hints.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull()))


def advance(state: dict | None, event: dict) -> tuple[dict | None, str]:
    """One event of a flow → the new state and what happened.

    Actions: start (with the hints found in documents), reply, starter (take the hint for a step), own (answer that step
    in own words), select (an organisation), go.  A refused action leaves the state alone and names the reason.
    """
    action, now = event["action"], event["at_ms"]
    if action == "start":
        fresh = {"chat_id": event["chat_id"], "step": 0, "selected": None, "touched": now, "consumed": False, "hints": event.get("hints") or {}}
        return {**fresh, "origins": {}, **dict.fromkeys(WIZARD_STEPS)}, "started"
    if state is None or state["chat_id"] != event["chat_id"]:
        return state, "unknown"
    if now - state["touched"] > _TTL_MS:
        return None, "expired"
    waiting = state["step"] < len(WIZARD_STEPS)
    if action in ("reply", "starter", "own"):
        if not waiting:
            return state, "not_waiting"
        slot = WIZARD_STEPS[state["step"]]
        if action != "reply" and event.get("step") != slot:
            return state, "stale_step"
        if action == "own":
            return {**state, "touched": now}, "own_wanted"
        text = (event.get("text") or "").strip()
        if action == "starter":
            text = text or state["hints"].get(slot, "")
            if not text:
                return state, "no_hint"
        if not text or text.startswith("/"):
            return state, "ignored"
        origin = FROM_DOCUMENTS if action == "starter" else FROM_MANAGER
        done = {**state, slot: text, "step": state["step"] + 1, "touched": now, "origins": {**state["origins"], slot: origin}}
        return done, "ready" if done["step"] == len(WIZARD_STEPS) else "accepted"
    if waiting:
        return state, "gate_not_ready"
    if action == "select":
        option = event.get("option")
        if option is None or not 0 <= option < ORGANISATIONS:
            return state, "ignored"
        return {**state, "selected": option, "touched": now}, "selected"
    if action == "go":
        if state["consumed"]:
            return state, "already_consumed"
        if state["selected"] is None:
            return state, "nothing_selected"
        return {**state, "consumed": True}, "go"
    return state, "ignored"


def _fold(token: str, state: dict | None, rows: list[Row]) -> tuple[dict | None, list[Row]]:
    """A token's events in order of time.  One whose flow is gone is expired, be it since the event before or for long:
    a stream no longer knows which."""
    out = []
    for row in sorted(rows, key=lambda r: (r.ts, r.update_id)):
        event = row.asDict() | {"at_ms": round(row.ts.timestamp() * 1000), "hints": dict(row.hints or {})}  # maps come as dicts or as pairs
        state, outcome = (None, "expired") if state is None and row.action != "start" else advance(state, event)
        shown = state or {"step": None, "selected": None, "origins": {}, **dict.fromkeys(WIZARD_STEPS)}
        step = WIZARD_STEPS[shown["step"]] if state and shown["step"] < len(WIZARD_STEPS) else None
        out.append(Row(token=token, update_id=row.update_id, outcome=outcome, step=step, selected=shown["selected"],
                       **{s: shown[s] for s in WIZARD_STEPS}, origins=shown["origins"]))
    return state, out


class Wizard(StatefulProcessor):
    """A flow's state by kind: what it waits for, the slots with their origins, the hints.  A timer at the end of its
    lifetime removes all of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", "chat_id bigint, step int, selected int, touched bigint, consumed boolean")
        self.slots = handle.getMapState("slots", "slot string", "text string, origin string")
        self.hints = handle.getMapState("hints", "slot string", "text string")

    def _load(self) -> dict | None:
        if not self.flow.exists():
            return None
        names = ("chat_id", "step", "selected", "touched", "consumed")
        state = dict(zip(names, self.flow.get())) | {"hints": {}, "origins": {}, **dict.fromkeys(WIZARD_STEPS)}
        if self.slots.exists():
            for (slot,), (text, origin) in self.slots.iterator():
                state[slot], state["origins"][slot] = text, origin
        if self.hints.exists():
            state["hints"] = {slot: text for (slot,), (text,) in self.hints.iterator()}
        return state

    def _clear(self) -> None:
        for state in (self.flow, self.slots, self.hints):
            state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, out = _fold(key[0], self._load(), list(rows))
        self._clear()
        if state is not None:
            self.flow.update((state["chat_id"], state["step"], state["selected"], state["touched"], state["consumed"]))
            for slot, origin in state["origins"].items():
                self.slots.updateValue((slot,), (state[slot], origin))
            for slot, text in state["hints"].items():
                self.hints.updateValue((slot,), (text,))
            self.handle.registerTimer(max(state["touched"] + _TTL_MS, timerValues.getCurrentWatermarkInMs()) + 1)
        return iter(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._clear()
        return iter([])

    def close(self) -> None:
        """Nothing is held but the state."""


def _events(events: DataFrame) -> DataFrame:
    hints = F.col("hints") if "hints" in events.columns else F.lit(None).cast("map<string,string>")
    return events.withColumn("hints", hints).select(*_EVENT)


def terms_flow(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Outcome of every event of every flow.

    events: token, update_id, chat_id, action, text, step, option, ts and, with starts, hints (``qualified_hints``).
    Needs a session whose streams keep state in RocksDB (``session.rocksdb_state``).
    """
    keyed = _events(events).withWatermark("ts", late).groupBy("token")
    return keyed.transformWithState(Wizard(), _OUT, "Append", "EventTime")


def replay_terms(events: DataFrame) -> DataFrame:
    """The same outcomes from a table of events: a token's rows pass by in order of time, and only its state is held."""
    dealt = _events(events).repartition("token").sortWithinPartitions("token", "ts", "update_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token = state = None
        names = [field.split(" ")[0] for field in _OUT.split(", ")]
        for frame in frames:
            rows = frame.astype(object).where(frame.notna(), None)
            out: list[Row] = []
            records = (Row(**dict(zip(_EVENT, r))) for r in rows.itertuples(index=False, name=None))
            for key, group in groupby(records, key=lambda r: r.token):
                if key != token:
                    token, state = key, None
                typed = [Row(**(r.asDict() | {"option": None if r.option is None else int(r.option)})) for r in group]
                state, found = _fold(token, state, typed)
                out += found
            yield pd.DataFrame([tuple(r[n] for n in names) for r in out], columns=names).astype({"selected": "Int32", "update_id": "Int64"})

    return dealt.mapInPandas(run, _OUT)


def rolling_history(turns: DataFrame, limit: int = HISTORY_MESSAGES) -> DataFrame:
    """After each batch, the last messages of every chat in it.

    turns: chat_id, turn, role, text, is_reset.  The state is at most ``limit`` messages per chat and the latest reset:
    a reset that comes late removes only what is older, and what comes late from before a reset stays out.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, roles, texts, reset = state.get if state.exists else ([], [], [], None)
        kept: list[tuple] = list(zip(turns, roles, texts))
        for frame in frames:
            rows = list(frame.itertuples(index=False))
            reset = max([r.turn for r in rows if r.is_reset] + ([] if reset is None else [reset]), default=None)
            kept += [(r.turn, r.role, r.text) for r in rows if not r.is_reset]
            kept = sorted(k for k in kept if reset is None or k[0] > reset)[-limit:]
        columns = [list(c) for c in zip(*kept)] if kept else [[], [], []]
        state.update((*columns, None if reset is None else int(reset)))
        yield pd.DataFrame({"chat_id": [key[0]] * len(kept), "turn": columns[0], "role": columns[1], "text": columns[2]})

    return turns.groupBy("chat_id").applyInPandasWithState(
        run,
        "chat_id bigint, turn bigint, role string, text string",
        "turns array<bigint>, roles array<string>, texts array<string>, reset bigint",
        "update",
        GroupStateTimeout.NoTimeout,
    )
