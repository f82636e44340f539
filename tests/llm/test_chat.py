import json

import pytest

from framequarry.llm import chat

M = "conv_id long, turn long, role string, text string, calls string"
C = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"
R = "conv_id long, turn long, call_id string"
S = "name string, field string, type string, required boolean"


def run(spark, messages, calls, results, schemas=()):
    df = chat.lines(*(spark.createDataFrame(list(x), s) for x, s in ((messages, M), (calls, C), (results, R), (schemas, S))))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
    return df


def test_links_orders_validates_and_serialises(spark):
    schemas = [("add", "a", "integer", True), ("add", "b", "number", False), ("say", "text", "string", True), ("say", "opts", "object", False), ("say", "list", "array", False)]
    calls = [
        (1, 1, "x", "add", '{"b": 2.5, "a": 1}', []),
        (1, 1, "y", "add", '{"a": "1", "z": 0}', ["x"]),
        (1, 3, "z", "say", '{"text":"é\\n", "opts":{"k":1,"a":[]}, "list":[1]}', ["y", "x", "nowhere"]),
        (1, 3, "bad", "say", "not json", None),
        (1, 3, "odd", "other", "{}", []),
        (2, 1, "x", "add", '{"b":true}', ["w"]),
        (2, 1, "w", "add", '{"a":1}', ["x"]),
        (2, 1, "v", "add", "[1]", ["w"]),
        (None, 1, "n", "add", "{}", []),
        (1, 1, None, "add", "{}", []),
    ]
    messages = [(1, 0, "user", "hi", "q"), (1, 1, "assistant", None, "q"), (1, 2, "tool", "3 ", "q"), (1, 3, "assistant", "", "q"), (1, 4, "tool", "r", "q"), (2, 1, "assistant", "c", "q"), (2, 2, "tool", "?", "q"), (None, None, None, None, None), (1, 0, "user", "hi", "q")]
    results = [(1, 2, "x"), (1, 4, "z"), (1, 6, "z"), (2, 2, "none"), (1, 9, None)]
    got = run(spark, messages, calls, results, schemas).collect()
    assert len(got) == len(messages)
    by = {(r.conv_id, r.turn): r for r in got}
    for r in got:
        parsed = json.loads(r.line)
        assert r.line == json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    first = json.loads(by[1, 1].line)["tool_calls"]
    assert [(c["id"], c["depth"], c["status"], c.get("errors")) for c in first] == [("x", 0, "linked", None), ("y", 1, "no_result", ["type a", "unknown z"])]
    assert first[0]["arguments"] == {"a": 1, "b": 2.5}
    third = {c["id"]: c for c in json.loads(by[1, 3].line)["tool_calls"]}
    assert third["z"]["depth"] == 2 and "errors" not in third["z"] and third["z"]["arguments"]["text"] == "é\n"
    assert third["bad"]["errors"] == ["not an object"] and third["bad"]["raw_arguments"] == "not json" and third["odd"]["errors"] == ["unknown tool"]
    cyc = {c["id"]: c for c in json.loads(by[2, 1].line)["tool_calls"]}
    assert all("depth" not in c for c in cyc.values()) and cyc["x"]["errors"] == ["missing a", "type b"] and cyc["v"]["errors"] == ["not an object"]
    assert by[2, 2].status == "no_call" and json.loads(by[2, 2].line)["tool_call_id"] == "none"
    assert by[1, 0].status == "plain" and by[None, None].line == "{}"
    assert (by[1, 1].status, by[1, 1].depth, by[1, 1].n_errors) == ("no_result", 1, 2)


def test_canonical_text(spark):
    text = "\u2028\u2029 \u0000\u001f\x7f\"\\/é€\U0001f600<>&"
    line = run(spark, [(1, 0, "user", text, None)], [], []).first().line
    want = json.dumps({"content": text, "conv_id": 1, "role": "user", "turn": 0}, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(line)["content"] == text and line.lower() == want.lower()


def graph():
    """Conversations of several shapes: identifiers with those they follow, and the depths by hand."""
    chain = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(60)}
    fan = {f"f{i}": [f"f{j}" for j in range(i)] for i in range(7)}
    cycle = {"a": ["c"], "b": ["a"], "c": ["b", "s"], "s": [], "t": ["s", "nowhere", None], "u": ["t", "a"], "self": ["self"]}
    return {
        1: (chain, {f"c{i}": i for i in range(60)}), 2: (fan, {f"f{i}": i for i in range(7)}),
        3: (cycle, {"a": None, "b": None, "c": None, "s": 0, "t": 1, "u": None, "self": None}), 4: ({"only": None}, {"only": 0}),
    }


@pytest.mark.parametrize("gather", [1024, 5])
def test_depths_in_one_expression_and_in_rounds(spark, monkeypatch, gather):
    monkeypatch.setattr(chat, "GATHER", gather)
    calls = [(conv, 99 - i, k, "t", "{}", after) for conv, (nodes, _) in graph().items() if gather > 5 or conv != 1 for i, (k, after) in enumerate(nodes.items())]
    linked = chat.link(spark.createDataFrame(calls, C), spark.createDataFrame([], R))
    got = {(r.conv_id, r.call_id): r.depth for r in chat.depths(linked).collect()}
    assert got == {(conv, k): want[k] for conv, (nodes, want) in graph().items() if gather > 5 or conv != 1 for k in nodes}


def test_a_chain_of_a_thousand_calls(spark):
    import time

    calls = [(1, i, f"c{i}", "t", "{}", [f"c{i - 1}"] if i else []) for i in range(1000)]
    linked = chat.link(spark.createDataFrame(calls, C), spark.createDataFrame([], R))
    began = time.time()
    assert {r.call_id: r.depth for r in chat.depths(linked).collect()} == {f"c{i}": i for i in range(1000)}
    assert time.time() - began < 60


def test_empty_tables(spark):
    assert run(spark, [], [], []).count() == 0
    assert [r.line for r in run(spark, [(1, 0, "user", "a", None)], [], []).collect()] == ['{"content":"a","conv_id":1,"role":"user","turn":0}']
