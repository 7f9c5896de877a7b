from __future__ import annotations

import json
import random

from lakecheck.llm import chat


def test_odd_texts_are_whole(spark):
    texts = ['a "quoted" \\ text of\nlines, "phrase": [1],"limit"' + "x" * n for n in range(2)] + ["é漢😀" * 3000, ""]
    talks = spark.createDataFrame([(i, 1, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    told = chat.rendered_calls(talks).selectExpr("conv_id", "try_variant_get(parse_json(text), '$.content', 'string') AS content", "try_variant_get(parse_json(text), '$.tool_calls[0].arguments.phrase', 'string') AS phrase").collect()
    for r in told:
        assert r.content == texts[r.conv_id] and r.phrase == (None if len(r.content) % 2 == 0 else r.content)


def call(identifier, after=()):
    return {"id": identifier, "name": "measure", "arguments": {"length": 1}, "after": list(after)}


def levels_brute(calls):
    """Longest way down, none in or behind a cycle or a missing call."""
    needs = {}
    for conv, name, after in calls:
        needs.setdefault((conv, name), set()).update((conv, a) for a in after or ())
    level = {k: 0 for k, after in needs.items() if not after}
    while True:
        more = {k: 1 + max(level[a] for a in after) for k, after in needs.items() if k not in level and after and all(a in level for a in after)}
        if not more:
            return level
        level |= more


def check_levels(spark, calls):
    df = spark.createDataFrame(calls, "conv_id string, call_id string, after array<string>")
    got = chat.call_levels(df).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == levels_brute(calls) and len(got) == len(levels_brute(calls))


def test_levels_of_many_shapes(spark):
    rng = random.Random(3)
    calls = [("chain", str(i), [str(i - 1)] if i else None) for i in range(70)]
    calls += [("ladder", str(i), [str(i - 1), str(i - 2)] if i > 1 else []) for i in range(6)]
    calls += [("loop", "a", ["b"]), ("loop", "b", ["c"]), ("loop", "c", ["a"]), ("loop", "d", ["a", "e"]), ("loop", "e", []), ("self", "x", ["x"]), ("self", "y", ["x"])]
    calls += [("gone", "a", ["nobody"]), ("gone", "b", ["a"]), ("gone", "c", ["b", "d"]), ("gone", "d", [])]
    calls += [("knot", "m", ["c", "r"]), ("knot", "c", ["m"]), ("knot", "r", []), ("twice", "a", []), ("twice", "a", ["b"]), ("twice", "b", [])]
    calls += [("star", str(i), ["hub"]) for i in range(50)] + [("star", "hub", ["0x"]), ("star", "0x", [])]
    for conv in range(12):
        n = rng.randint(2, 25)
        calls += [(f"r{conv}", str(i), [str(rng.randint(0, n)) for _ in range(rng.choice([0, 1, 1, 2, 3]))]) for i in range(n)]
    for conv in range(12):
        n = rng.randint(2, 25)
        calls += [(f"d{conv}", str(i), [str(rng.randrange(i)) for _ in range(rng.choice([0, 1, 1, 2, 3]))] if i else []) for i in range(n)]
    check_levels(spark, calls)


def test_a_chain_of_2000_calls_takes_few_rounds(spark, monkeypatch):
    rounds, settle = [], chat._settle
    monkeypatch.setattr(chat, "_settle", lambda *a: rounds.append(1) or settle(*a))
    check_levels(spark, [("c", str(i), [str(i - 1)] if i else []) for i in range(2000)])
    assert len(rounds) <= 12


def test_late_turns_white_space_and_unnamed_conversations(spark):
    rows = [
        (None, 40_000, "assistant", json.dumps({"content": "x" * 100_000, "tool_calls": [call("a"), call("b", ["a"])]})),
        (None, 40_001, "tool", ' \t\r\n{"tool_call_id":"a","content":1}'), ("", 40_002, "tool", '{"tool_call_id":"b","content":2}'),
        (None, 70_000, "assistant", "\n" + json.dumps({"tool_calls": [call("a")]})), ("", 1, "user", None),
    ]
    messages = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {(r.conv_id, r.turn, r.part): r for r in chat.link_tool_calls(messages, chat.SCHEMAS).collect()}
    assert got[None, 40_000, 1].status == "ok" and '"result":1' in got[None, 40_000, 1].json and len(got[None, 40_000, 0].json) > 100_000
    assert (got[None, 40_000, 2].status, got[None, 40_000, 2].level) == ("no_result", 1)
    assert got[None, 70_000, 1].status == "duplicate_id" and got["", 40_002, 0].status == "orphan" and len(got) == 7


def test_many_calls_in_a_message(spark):
    calls = json.dumps({"tool_calls": [call(f"c{i}") for i in range(70_000)] + [call("c5")]})
    got = chat.link_tool_calls(spark.createDataFrame([("t", 3, "assistant", calls)], "conv_id string, turn int, role string, text string"), chat.SCHEMAS)
    assert {r.status: r["count"] for r in got.where("part > 0").groupBy("status").count().collect()} == {"no_result": 70_000, "duplicate_id": 1}
