"""Chat windows: read back exactly, within budgets, every target learnt once."""

import hashlib
import random
from collections import defaultdict

import pytest

from docsluice.llm import chat
from docsluice.llm.queries import tokenizer_file

WORDS = tokenizer_file("byte_bpe_50k.json")
TRICKY = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<\\s>", "<<SYS>>\n<</SYS>>\n\n", "<s><s>", "[ROLE]x[TEXT]y[/ROLE]", " ", "\n", "", "<<s>", "[[INST]", "é🙂", None]


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, start string, tokens int").repartition(parts)


def rows(seed=4, many=60):
    rng = random.Random(seed)
    out = []
    for conv in range(many):
        kinds = ["system"] * rng.randint(0, 1) + [rng.choice(["user", "assistant", "assistant", "tool", "system", None, "a[TEXT]b"]) for _ in range(rng.randint(0, 9))]
        for turn, role in enumerate(kinds):
            out.append((conv, turn, role, rng.choice(TRICKY) if rng.random() < 0.5 else "word " * rng.randint(0, 80)))
    return out + [(None, None, None, None), (None, 1, "assistant", "a"), (7, None, "user", "tie"), (7, None, "user", "tie"), (-1, 0, "user", TRICKY[0]), (-1, 1, "assistant", TRICKY[0])]


def hot(turns=3000):
    rng = random.Random(9)
    return [(500, t, "system" if t == 0 else ("user", "assistant")[t % 2], f"turn {t} " + "go on " * rng.randint(0, 30)) for t in range(turns)]


def brute(data):
    by_conv = defaultdict(list)
    for conv, turn, role, text in data:
        by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by_conv.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget,history", [(2048, 256), (120, 30), (1, 1)])
def test_digest(spark, budget, history):
    data = rows() + hot(300)
    wins = chat.windows(frame(spark, data), WORDS, budget, history)
    got = {r["conv_id"]: r for r in chat.digest(wins).collect()}
    want = brute(data)
    assert set(got) == set(want)
    for conv, facts in want.items():
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == facts


def test_windows_of_a_hot_conversation(spark):
    data = hot()
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")  # so the conversation lies in many partitions
    try:
        got = sorted(chat.windows(frame(spark, data), WORDS, 400, 80).collect(), key=lambda r: r["window"])
    finally:
        spark.conf.set(conf, before)
    words = chat._vocabulary(WORDS)
    texts, seen, targets = [t for *_, t in data], 0, 0
    assert len(got) < 2 * sum(r["n_tokens"] for r in got) / 300
    for k, r in enumerate(got):
        turns = chat.read_turns(r["formatted"])
        assert r["n_tokens"] <= 400 and not r["over_budget"] and len(turns) == r["n_lead"] + r["n_history"] + r["n_own"]
        own = turns[r["n_lead"] + r["n_history"] :]
        assert [t for _, t in own] == texts[seen : seen + len(own)]
        if k:
            assert r["n_lead"] == 1 and turns[0] == ("system", texts[0])
            past = [t for _, t in turns[1 : 1 + r["n_history"]]]
            assert past == texts[max(1, seen - len(past)) : seen] and len(past) > 0
            size = sum(len(words.encode(chat.write_turn(*t)[0])) for t in turns[1 : 1 + r["n_history"]])
            assert size <= 80
            assert seen - len(past) <= 1 or size + len(words.encode(chat.write_turn(data[seen - len(past) - 1][2], texts[seen - len(past) - 1])[0])) > 80
        learnt = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["mask"]]
        assert learnt == [t for role, t in own if role == "assistant"]
        seen, targets = seen + len(own), targets + len(learnt)
    assert seen == len(data) and targets == sum(role == "assistant" for _, _, role, _ in data)


def test_very_long_turns_stand_alone(spark):
    data = [(1, 0, "system", "rules"), (1, 1, "user", "long " * 60_000), (1, 2, "assistant", "short"), (1, 3, "user", "x" * 9000), (1, 4, "assistant", "end")]
    got = sorted(chat.windows(frame(spark, data), WORDS, 200, 40).collect(), key=lambda r: r["window"])
    assert [r["over_budget"] for r in got].count(True) == 2
    assert sum(r["n_own"] for r in got) == 5
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest(chat.windows(frame(spark, data), WORDS, 200, 40)).collect()} == brute(data)


def test_escapes_come_back():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice([*chat.CONTROLS, "\\", "<", "[", "/", "s>", "INST]", " ", "a", "\n"]) for _ in range(rng.randint(0, 8)))
        body = chat.escape(text)
        assert chat.unescape(body) == text and not any(c in body for c in chat.CONTROLS)
        for role in ("system", "user", "assistant", "tool", "", text):
            turn, at, long = chat.write_turn(role, text)
            assert chat.read_turns(chat.START + turn + turn) == [(role, text)] * 2 and turn[at : at + long] == body


def test_empty_table(spark):
    assert chat.digest(chat.windows(frame(spark, rows()[:3]).where("false"), WORDS)).count() == 0
