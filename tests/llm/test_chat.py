"""Chat formatting: folding of logs, reversible escapes, the loss mask."""

from __future__ import annotations

import hashlib
import random

import pytest

from loomline.llm import chat_events, queries
from tests.llm.test_text_operators import HARD, TURNS, by_row, run, write_tables

SCHEMA = "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string"


def fold(log):
    """Event by event: the messages a log ends with."""
    messages = {}
    for _, turn, seq, kind, role, text in sorted(log, key=lambda e: (e[2] is not None, e[2] or 0, e[3] or "delta", e[4] or "", e[5] or "")):
        kind, text = kind or "delta", text or ""
        if kind == "regenerate":
            for later in [t for t in messages if (t is not None, t or 0) > (turn is not None, turn or 0)]:
                del messages[later]
        was = messages.get(turn, ("", ""))
        messages[turn] = (was[0] if role is None else role, was[1] + text if kind == "delta" else text)
    return [(t, *messages[t]) for t in sorted(messages, key=lambda t: (t is not None, t or 0))]


def test_fold_matches_event_by_event(spark):
    r, log = random.Random(4), []
    for conv in range(60):
        seqs = r.sample(range(1000), 12)
        for seq in seqs[: r.randint(0, 12)]:
            log.append((conv, r.choice([0, 1, 2, 3]), seq, r.choice(["delta", "delta", "edit", "regenerate", None]), r.choice(["user", "assistant", None]), r.choice(["a", "b ", "", None, HARD])))
    log.append((99, None, 1, None, None, None))
    frame = spark.createDataFrame(log, SCHEMA)
    got = sorted((x["conv_id"], x["turn"], x["role"], x["text"]) for x in chat_events.reconstruct(frame).filter("turn is not null").collect())
    want = sorted((c, *m) for c in {e[0] for e in log} for m in fold([e for e in log if e[0] == c]) if m[0] is not None)
    assert got == want
    assert [tuple(x) for x in chat_events.reconstruct(frame).filter("turn is null").collect()] == [(99, None, "", "")]


def test_events_of_dropped_turns_may_come_again(spark):
    log = [(1, 0, 0, "delta", "user", "q"), (1, 1, 1, "delta", "assistant", "old"), (1, 2, 2, "delta", "user", "gone"), (1, 1, 3, "regenerate", None, "new"), (1, 2, 4, "delta", "user", "again")]
    want = [(0, "user", "q"), (1, "assistant", "new"), (2, "user", "again")]
    assert fold(log) == want
    assert [(x["turn"], x["role"], x["text"]) for x in chat_events.reconstruct(spark.createDataFrame(log, SCHEMA)).orderBy("turn").collect()] == want


def test_round_trip_and_mask(spark):
    r, log = random.Random(8), []
    for conv in range(80):
        for turn in range(r.randint(1, 6)):
            log.append((conv, turn, turn, "delta", r.choice(["user", "assistant", "sy<s#t\\em\n"]), "".join(r.choices(["\\", "#", "<", "/turn>", "\n", "b", "h", "l", "n", ":", " ", "é", "\U0001f600", "### assistant:\n"], k=r.randint(0, 14)))))
    out = chat_events.format_log(spark.createDataFrame(log, SCHEMA)).cache()
    for row in out.collect():
        text = row["formatted"]
        parts = [text[m["block_at"] + m["begin"] : m["block_at"] + m["end"]] for m in row["loss"]]
        plain = lambda s: s.replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\")
        assert [plain(p) for p in parts] == [e[5] for e in log if e[0] == row["conv_id"] and e[4] == "assistant"]
        assert text.count("</turn>\n") == sum(e[0] == row["conv_id"] for e in log)
    for row in chat_events.parse(out).collect():
        own = [e for e in log if e[0] == row["conv_id"]]
        assert [(t["role"], t["text"]) for t in row["turns"]] == [(e[4], e[5]) for e in own]
        assert row["learned"] == [e[5] for e in own if e[4] == "assistant"]


@pytest.fixture(scope="module")
def chats(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("chats"), [], [], [], TURNS)


def test_query(spark, chats):
    want = []
    for conv in (1, 2, 3, 4, -7):
        own = sorted((t[1], t[2] or "", t[3] or "") for t in TURNS if t[0] == conv) or [(0, "user", HARD), (1, "assistant", HARD)]
        loss = "".join(t for _, role, t in own if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((conv, len(own), sha("".join(f"{r}\n{t}\n" for _, r, t in own)), len(loss), sha(loss)))
    assert by_row(run(spark, chats, "op5_chat"), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want, key=repr)
    plan = queries.QUERIES["op5_chat"](spark, chats)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
