"""Chat formatting in budgeted windows of whole turns.

Turns of a conversation stand in order of turn (null first), role and text.  Each is written between the template's
marks, with control strings inside it escaped so that they can be read back, and its tokens are counted.  Prefix sums of
these counts place every turn in a stretch of its conversation; a stretch becomes one window, or two where its last
turn does not fit.  A window begins with the conversation's system turn, if its first turn is one, goes on with at most
``history`` tokens of the turns just before it, and then has its own turns.  Every turn is a window's own exactly once;
the loss mask covers the texts of a window's own assistant turns and never a repeated one.

Prefix sums run over a range-partitioned table: within a partition as rows pass by, and over partitions by one row for
each conversation and partition.  So a conversation may hold any share of the rows.  A stretch holds at most a budget
of tokens and one more turn, so what meets in one place is bounded by the budget and the longest turn.

A null text is empty, a null role is the empty role; roles other than system, user and assistant keep their names.  A
null conv_id is a conversation like any other.  Repeated rows are turns of their own.  Turns are never cut: one that
is longer than the budget gets a window marked ``over_budget``.  An empty table gives no windows.  Columns other than
conv_id, turn, role and text play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsluice.llm.alignment import ByteVocabulary, cut
from docsluice.llm.common import slices, written

BUDGET, HISTORY = 2048, 256  # tokens of a window, and of the turns it repeats
START = "<s>"
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
CONTROLS = (START, "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", *OTHER)
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Backslashes doubled, and one put behind the first sign of every control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template's marks, and where its text begins and how long it is there."""
    body = escape(text)
    if role in MARKS:
        before, behind = MARKS[role]
    else:
        before, behind = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
    return before + body + behind, len(before), len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of all turns of a window, repeated ones too."""
    out, at = [], len(START)
    while at < len(formatted):
        if formatted.startswith(OTHER[0], at):
            middle = formatted.index(OTHER[1], at)
            stop = formatted.index(OTHER[2], middle)
            out.append((unescape(formatted[at + len(OTHER[0]) : middle]), unescape(formatted[middle + len(OTHER[1]) : stop])))
            at = stop + len(OTHER[2])
            continue
        role = next(r for r, (before, _) in MARKS.items() if formatted.startswith(before, at))
        before, behind = MARKS[role]
        first = at + len(before)
        # The closing control string cannot stand in a text; the white space around it is the template's.
        stop = formatted.index(behind.strip(), first) - (len(behind) - len(behind.lstrip()))
        out.append((role, unescape(formatted[first:stop])))
        at = stop + len(behind)
    return out


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> ByteVocabulary:
    return ByteVocabulary(path)


def _room(lead: str, budget: int, history: int):
    """Tokens of own turns in a window: what the repeated turns leave, a quarter of the budget at least."""
    return F.greatest(F.lit(budget - history) - F.col(lead), F.lit(max(1, budget // 4)))


_TURNS = pa.schema([
    ("part", pa.int32()), ("conv_id", pa.int64()), ("nth", pa.int64()), ("start", pa.int64()), ("tokens", pa.int64()), ("lead", pa.int64()),
    ("body", pa.string()), ("role", pa.string()), ("at", pa.int64()), ("long", pa.int64()),
])
_TURN_DDL = "part int, conv_id long, nth long, start long, tokens long, lead long, body string, role string, at long, long long"


def _turns(conversations: DataFrame, vocabulary_path: str) -> DataFrame:
    """Written turns in order, with the tokens before each in its conversation and partition."""
    none = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    ordered = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = _vocabulary(vocabulary_path), TaskContext.get().partitionId()
        conv, nth, start, lead = object(), 0, 0, 0
        for batch in batches:
            for some in slices(batch, 3):
                out = []
                for c, role, text in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), some.column(3).to_pylist()):
                    body, at, long = write_turn(role, text)
                    # Pieces of a long turn are counted apart; one is cut at a space only, where tokens end.
                    tokens = sum(len(words.encode(p if i == 0 else " " + p)) for i, p in enumerate(cut(body)))
                    if c != conv:
                        conv, start, lead = c, 0, tokens if role == "system" else 0
                    out.append((part, c, nth, start, tokens, lead, body, role, at, long))
                    nth, start = nth + 1, start + tokens
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _TURNS)], schema=_TURNS)

    return ordered.mapInArrow(work, _TURN_DDL)


_WINDOWS = "conv_id long, window long, n_tokens long, n_lead int, n_history int, n_own int, over_budget boolean, formatted string, mask array<struct<start:long,length:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_WINDOW_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int64()), ("n_tokens", pa.int64()), ("n_lead", pa.int32()), ("n_history", pa.int32()), ("n_own", pa.int32()),
    ("over_budget", pa.bool_()), ("formatted", pa.string()), ("mask", _SPAN),
])
LEAD, BEFORE, OWN = 0, 1, 2  # what a row is to its stretch


def build(rows: list[tuple], budget: int, history: int) -> Iterator[tuple]:
    """Windows of one stretch, from its rows (conv_id, stretch, kind, start, tokens, room, body, role, at, long) in order."""
    lead = [r for r in rows if r[2] == LEAD]
    before = [r for r in rows if r[2] == BEFORE]
    own = [r for r in rows if r[2] == OWN]
    windows: list[list[tuple]] = []
    left = 0
    for r in own:
        if not windows or r[4] > left:
            windows.append([])
            left = r[5]
        windows[-1].append(r)
        left -= r[4]
    for k, turns in enumerate(windows):
        opening = lead if k == 0 or lead else [r for r in windows[0] if r[3] == 0 and r[7] == "system"]
        past = [r for r in before + (windows[0] if k else []) if turns[0][3] - r[3] <= history and r not in opening]
        shown, text, mask, chars = [*opening, *past, *turns], [START], [], len(START)
        for i, r in enumerate(shown):
            if i >= len(shown) - len(turns) and r[7] == "assistant":
                mask.append({"start": chars + r[8], "length": r[9]})
            text.append(r[6])
            chars += len(r[6])
        total = sum(r[4] for r in shown)
        yield r[0], 2 * r[1] + k, total, len(opening), len(past), len(turns), total > budget, "".join(text), mask


def windows(conversations: DataFrame, vocabulary_path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_tokens, n_lead, n_history, n_own, over_budget, formatted, mask); window numbers rise along a
    conversation, with gaps.  Mask spans are code points of ``formatted``."""
    history = min(history, max(1, budget // 4))
    turns = written(_turns(conversations, vocabulary_path), "chat-turns")
    # One row for each conversation and partition; a partition has at most one conversation that began before it.
    parts = turns.groupBy("conv_id", "part").agg(F.sum("tokens").alias("total"), F.max("lead").alias("lead"))
    along = Window.partitionBy("conv_id").orderBy("part")
    parts = parts.select(
        "conv_id", "part",
        F.coalesce(F.sum("total").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.first("lead").over(along).alias("true_lead"),
        F.sum("total").over(Window.partitionBy("conv_id")).alias("whole"),
    )
    carried = parts.where("before > 0").select("part", F.col("conv_id").alias("begun"), "before", "true_lead")
    placed = (
        turns.join(F.broadcast(carried), (turns["part"] == carried["part"]) & turns["conv_id"].eqNullSafe(F.col("begun")), "left").drop(carried["part"])
        .withColumn("start", F.col("start") + F.coalesce("before", F.lit(0)))
        .withColumn("lead", F.coalesce("true_lead", "lead"))
        .withColumn("room", _room("lead", budget, history))
        .withColumn("stretch", F.expr("start div room"))
    )
    fields = ["conv_id", "stretch", "kind", "start", "tokens", "room", "body", "role", "at", "long"]
    own = placed.withColumn("kind", F.lit(OWN)).select(*fields)
    # A turn that ends a stretch is history of the next one; the system turn comes first anyway.
    past = (
        placed.where((F.expr(f"(start + {history}) div room") > F.col("stretch")) & ~((F.col("start") == 0) & (F.col("lead") > 0)))
        .withColumns({"kind": F.lit(BEFORE), "stretch": F.col("stretch") + 1}).select(*fields)
    )
    long = parts.where("before = 0 and true_lead > 0").withColumn("room", _room("true_lead", budget, history)).where("whole > room")
    stretches = long.select(F.col("conv_id").alias("c"), F.expr("(whole - 1) div room").alias("last"))
    # Numbers in two steps, so that no row holds an array of them all.
    copies = (
        placed.where("start = 0 and lead > 0").join(stretches, F.col("conv_id").eqNullSafe(F.col("c")))
        .withColumn("block", F.explode(F.expr("sequence(0l, last div 1024)")))
        .withColumn("stretch", F.explode(F.expr("sequence(greatest(1l, block * 1024), least(last, block * 1024 + 1023))")))
        .withColumn("kind", F.lit(LEAD)).select(*fields)
    )
    met = own.unionByName(past).unionByName(copies).repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "start", "kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for some in slices(batch, 6):
                    yield from zip(*(c.to_pylist() for c in some.columns))

        out, size = [], 0
        for _, stretch in groupby(rows(), key=lambda r: r[:2]):
            for window in build(list(stretch), budget, history):
                out.append(window)
                size += len(window[7])
            if size > 1 << 20:
                yield _arrow(out, _WINDOW_ARROW)
                out, size = [], 0
        if out:
            yield _arrow(out, _WINDOW_ARROW)

    return met.mapInArrow(work, _WINDOWS)


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def digest(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from windows.

    A conversation's hash runs through its windows one after the other, as they pass by in order.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now = state = None

        def done() -> None:
            if state is not None:
                out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for some in slices(batch, 3):
                for conv, _, skipped, text, mask in zip(*(c.to_pylist() for c in some.columns)):
                    if state is None or conv != now:
                        done()
                        now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    turns = read_turns(text)[skipped:]
                    state[0] += len(turns)
                    for role, body in turns:
                        state[1].update(f"{role}\n{body}\n".encode())
                    for span in mask:
                        learnt = unescape(text[span["start"] : span["start"] + span["length"]])
                        state[2] += len(learnt)
                        state[3].update(learnt.encode())
                    state[4] += len(text)
                if len(out) > 4096:
                    yield _arrow(out, schema)
                    out.clear()
        done()
        if out:
            yield _arrow(out, schema)

    # Repeated turns: the lead of all windows but the first, and the history.
    rows = formatted.select("conv_id", "window", (F.expr("n_lead") + F.col("n_history")).alias("skipped"), "formatted", "mask")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(
        work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
