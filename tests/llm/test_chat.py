"""Chat formatting: order against brute force, and texts that a model may send."""

import json
import random

from gatewarden.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def call(id_, name, args):
    return json.dumps({"tool_calls": [{"id": id_, "name": name, "arguments": args}]})


def brute_levels(calls, results):
    """Longest path from a message that waits for nothing; None on or behind a cycle."""
    before = {("c", c): {("r", r) for r in refs if r in results} for c, refs in calls.items()}
    before |= {("r", r): {("c", r)} & before.keys() for r in results}
    level = {}
    while True:
        free = [n for n, b in before.items() if n not in level and all(x in level for x in b)]
        if not free:
            return level
        for n in free:
            level[n] = 1 + max((level[x] for x in before[n]), default=-1)


def test_order_equals_brute_force(spark):
    r = random.Random(1)
    rows, want = [], {}
    for conv in range(6):
        names = [f"k{i}" for i in range(12)]
        back = conv % 2 == 0  # without cycles
        calls = {n: r.sample(names[:i] if back else names, min(i if back else 12, r.randrange(4))) for i, n in enumerate(names) if r.random() < 0.9}
        results = {n for n in names if r.random() < 0.8}
        turns = [("assistant", call(n, "f", {"a": [{"$ref": x} for x in refs]})) for n, refs in calls.items()] + [("tool", json.dumps({"tool_call_id": n, "content": 1})) for n in sorted(results)]
        r.shuffle(turns)
        rows += [(conv, i, *t) for i, t in enumerate(turns)]
        level = brute_levels(calls, results)
        want |= {(conv, k, n): (level.get((k, n)), n in (results if k == "c" else calls)) for k, ns in (("c", calls), ("r", results)) for n in ns}
    got = {(x["conv_id"], x["kind"][0], x["call_id"]): (x["level"], x["linked"]) for x in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and any(v[0] is None for v in want.values()) and max(v[0] or 0 for v in want.values()) > 3


def test_hostile_messages(spark):
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    nested = '{"tool_calls":[{"id":"d","name":"f","arguments":' + '{"a":' * 150 + "1" + "}" * 150 + "}]}"
    rows = [
        (1, 0, "assistant", '{"tool_calls":[{"id":"\\ud800","name":"\\udfff","arguments":{"x":"\\ud800","$ref":"\\udc00"}}]}'),
        (1, 1, "assistant", json.dumps({"tool_calls": [{"id": "t", "name": "f", "arguments": deep}]})),
        (1, 2, "assistant", deep), (1, 3, "assistant", nested),
        (1, 4, "assistant", '{"tool_calls":[{"id":"n","name":"f","arguments":{"x":' + "9" * 400 + "}}]}"),
        (1, 5, "assistant", '{"tool_calls":[{"id":"q","name":"f","arguments":{"x":NaN}}]}'), (1, 6, "assistant", '{"tool_calls":[{"id":"i","name":"f","arguments":{"x":1e999}}]}'),
        (1, 7, "assistant", '{"tool_calls":[]}'), (1, 8, "tool", '{"tool_call_id":"\\ud800","content":"\\ud800"}'), (1, 9, "user", "x" * 300_000),
    ]
    schema = {"f": {"type": "object", "properties": {"x": {"type": "integer"}}}}
    got = {x["turn"]: x for x in chat.format_chats(spark.createDataFrame(rows, SCHEMA), schema).collect()}
    assert [got[i]["kind"] for i in range(10)] == ["call", "call", "text", "call", "call", "text", "text", "text", "result", "text"]
    assert got[0]["call_id"] == "\\ud800" and got[0]["name"] == "\\udfff" and got[0]["linked"] and got[8]["linked"]
    assert got[1]["valid"] is False and got[3]["valid"] and got[4]["valid"]
    assert all(json.loads(x["json"]) for x in got.values()) and "NaN" in json.loads(got[5]["json"])["content"]


def test_values():
    ok = lambda v, **s: chat.validate(v, s)
    assert not ok(True, enum=[1]) and ok(1.0, enum=[1]) and not ok([True], enum=[[1]]) and ok({"a": 1.0}, enum=[{"a": 1}])
    assert ok(2.0, type="integer") and not ok(2.5, type="integer") and not ok(True, type="number") and ok(10**400, type="integer")


def test_repeated_identifier_is_the_earliest(spark):
    rows = [(1, 5, "assistant", call("a", "f", {"$ref": "b"})), (1, 2, "assistant", call("a", "f", {})), (1, None, "assistant", call("a", "f", {"$ref": "b"})), (1, 3, "assistant", call("b", "f", {})), (1, 4, "tool", '{"tool_call_id":"b"}')]
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    assert {(x["turn"], x["level"]) for x in out.collect()} == {(5, 0), (2, 0), (None, 0), (3, 0), (4, 1)}


def test_derived_turns_have_all_cases(spark, data):
    rows = [x.asDict() for x in chat.op10_chat_formatting(spark, data).collect()]
    assert len(rows) == spark.read.parquet(f"{data}/conversations.parquet").count()
    calls = [x for x in rows if x["kind"] == "call"]
    assert {x["valid"] for x in calls} == {x["linked"] for x in calls} == {True, False}
    assert any(x["level"] is None for x in calls) and max(x["level"] or 0 for x in rows) >= 3
