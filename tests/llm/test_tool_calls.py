from __future__ import annotations

import json

from stratalist.llm import tool_calls as tc

SCHEMAS = {"search": {"q": ("string", True), "limit": ("integer", False)}, "noop": {}}


def rows(spark, calls, results):
    c = spark.createDataFrame(calls, "conv_id long, call_id string, parent_id string, turn long, name string, arguments string")
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string, status string")
    return tc.link_calls(c, r, SCHEMAS).collect()


def test_linking_levels_and_errors(spark):
    calls = [
        (1, "a", None, 1, "search", '{"limit": 3, "q": "x"}'), (1, "b", "a", 2, "search", '{"q": 7}'), (1, "c", "b", 3, "noop", "{}"), (1, "d", "zz", 4, "gone", "{}"),
        (1, "e", "f", 5, "noop", "{}"), (1, "f", "e", 6, "noop", None), (1, "a", None, 9, "noop", "{}"), (1, "a", None, 9, "noop", "{}"), (2, "a", None, 1, "search", "not json"),
        (3, None, None, 1, "noop", "{}"), (4, "s", "s", 1, "noop", "[1]"),
    ]
    calls += [(5, str(i), str(i - 1), i, "noop", "{}") for i in range(100)]
    results = [(1, "a", 2, "ok \"q\"\n", "clash"), (1, "a", 3, "later", "clash"), (1, "c", 4, None, None), (9, "x", 1, "lost", None), (1, "a", 2, "ok \"q\"\n", "clash")]
    got = {(r.conv_id, r.call_id, r.turn): r for r in rows(spark, calls, results)}
    assert len(got) == 11 - 1 + 100 + 2
    assert [got[1, x, t].level for x, t in (("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5), ("f", 6))] == [0, 1, 2, 0, -1, -1]
    assert [got[1, x, t].status for x, t in (("a", 1), ("b", 2), ("c", 3), ("e", 5), ("a", 9), ("a", 3))] == ["linked", "pending", "linked", "cycle", "repeated", "repeated"]
    assert got[9, "x", 1].status == "orphan" and got[3, None, 1].status == "pending" and got[4, "s", 1].level == -1
    assert [got[k].errors for k in ((1, "a", 1), (1, "b", 2), (1, "d", 4), (2, "a", 1), (1, "f", 6), (4, "s", 1))] == ["", "q: not string", "unknown tool", "arguments: not an object", "arguments: not an object", "arguments: not an object"]
    text = got[1, "a", 1].json
    assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(text) == {"call": {"arguments": {"limit": 3, "q": "x"}, "id": "a", "name": "search"}, "result": {"content": 'ok "q"\n', "turn": 2}, "status": "linked", "turn": 1}
    assert {r.turn: r.level for k, r in got.items() if k[0] == 5} == {i: i for i in range(100)}


def test_empty_and_null_messages(spark):
    ddl = "conv_id long, turn long, role string, text string, json string"
    assert tc.format_chats(spark.createDataFrame([], ddl)).count() == 0
    rows = [(1, 0, None, None, "x"), (1, 1, "user", None, "x"), (1, 2, "assistant", "", "x"), (None, 1, "user", "a", None), (2, 0, "user", "w " * 100_000, None), (2, 1, "system", "s", None)]
    got = {(r.conv_id, r.turn): (r.kind, r.status, r.errors) for r in tc.format_chats(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {(1, 0): ("message", "plain", ""), (1, 1): ("call", "linked", "chars: missing; text: missing"), (None, 1): ("call", "pending", "text: shorter than 40"), (2, 0): ("call", "pending", "chars: above 256"), (2, 1): ("message", "plain", "")}


def test_limits_of_a_schema(spark):
    schemas = {"t": {"n": ("number", True, {"minimum": 1, "maximum": 2.5}), "s": ("string", False, {"minLength": 2, "maxLength": 3})}}
    texts = ['{"n": 1, "s": "ab"}', '{"n": 0.5}', '{"n": 3, "s": "a"}', '{"n": 2.5, "s": "abcd"}', '{"n": "1"}', '{"s": "éé"}']
    calls = spark.createDataFrame([(1, str(i), None, i, "t", x) for i, x in enumerate(texts)], "conv_id long, call_id string, parent_id string, turn long, name string, arguments string")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {r.turn: r.errors for r in tc.link_calls(calls, results, schemas).collect()}
    assert got == {0: "", 1: "n: below 1", 2: "n: above 2.5; s: shorter than 2", 3: "s: longer than 3", 4: "n: not number", 5: "n: missing"}
