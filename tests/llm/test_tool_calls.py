import json

from plumbline.llm import tool_calls

CALLS = "conv_id long, turn int, call_id string, name string, arguments string, status string, level int"
RESULTS = "conv_id long, turn int, call_id string, content string, position int"
SCHEMAS = [("f", "a", "integer", True), ("f", "b", "number", False), ("f", "c", "string", False), ("f", "o", "object", False), ("f", "l", "array", False), ("f", "t", "boolean", False)]


def run(spark, calls, results):
    c = spark.createDataFrame([(*x, "s", 1) for x in calls], CALLS)
    r = spark.createDataFrame([(*x, 1) for x in results], RESULTS)
    s = spark.createDataFrame(SCHEMAS, "name string, field string, type string, required boolean")
    return tool_calls.link_tool_calls(c, r, s).collect()


def test_statuses_levels_and_positions(spark):
    calls = [
        (1, 1, "x", "f", '{"a": 1}'), (1, 3, "y", "f", '{"a":2,"c":"$ref:x"}'), (1, 5, "z", "f", '{"c":"$ref:y","a":3,"l":["$ref:x"]}'),
        (1, 6, "x", "f", '{"a": 9}'), (1, 7, "p", "f", '{"c":"$ref:q"}'), (1, 8, "q", "f", '{"c":"$ref:p"}'), (1, 9, "m", "f", '{"c":"$ref:nowhere"}'),
        (1, 10, "n", "f", '{"c":"$ref:m"}'), (1, 11, "w", "f", '{"a":1}'), (2, 1, "x", "f", '{"a":1}'), (2, 1, "x", "f", '{"a":1}'), (3, 1, None, "f", "{}"), (None, 1, "x", "f", "{}"),
    ]
    results = [(1, 2, "x", "r1"), (1, 4, "x", "r2"), (1, 4, "y", "r3"), (1, 5, "z", "same turn"), (1, 12, "z", "r4"), (2, 3, "x", None), (2, 3, "x", None), (1, 2, "nobody", "r"), (1, 2, None, "r")]
    rows = run(spark, calls, results)
    got = sorted(((str(r.conv_id), r.turn, str(r.call_id), r.status, r.level, r.position) for r in rows if r.kind == "call"), key=str)
    assert got == sorted([
        ("1", 1, "x", "linked", 0, 1), ("1", 3, "y", "linked", 1, 3), ("1", 5, "z", "linked", 2, 4), ("1", 6, "x", "duplicate_id", None, None), ("1", 7, "p", "unresolved", None, None),
        ("1", 8, "q", "unresolved", None, None), ("1", 9, "m", "missing_reference", None, None), ("1", 10, "n", "unresolved", None, None), ("1", 11, "w", "no_result", 0, 2),
        ("2", 1, "x", "linked", 0, 1), ("2", 1, "x", "duplicate_id", None, None), ("3", 1, "None", "no_id", None, None), ("None", 1, "x", "no_id", None, None),
    ], key=str)
    back = sorted((str(r.conv_id), r.turn, str(r.call_id), r.status, r.position) for r in rows if r.kind == "result")
    assert back == [("1", 2, "None", "no_id", None), ("1", 2, "nobody", "orphan", None), ("1", 2, "x", "linked", 1), ("1", 4, "x", "duplicate_result", None), ("1", 4, "y", "linked", 3), ("1", 5, "z", "before_call", None), ("1", 12, "z", "linked", 4), ("2", 3, "x", "duplicate_result", None), ("2", 3, "x", "linked", 1)]


def test_errors_and_canonical_messages(spark):
    odd = 'tab\t "quote" \\ é / \u0001'
    arguments = {
        "1": json.dumps({"b": 1.5, "a": 7, "c": odd, "o": {"z": 1, "y": [True, None]}}), "2": '{"a":"1"}', "3": "{}", "4": "[1]", "5": "nope", "6": None, "7": '{"a":1,"zz":1}', "8": '{"a":1.0,"b":2,"l":{},"t":0,"c":null}', "9": '{"a":1}',
    }
    calls = [(1, int(k), k, "g" if k == "9" else "f", v) for k, v in arguments.items()]
    rows = {r.call_id: r for r in run(spark, calls, [(1, 50, "1", odd)]) if r.kind == "call"}
    assert {k: r.errors for k, r in rows.items()} == {"1": "", "2": "type:a", "3": "missing:a", "4": "not_an_object", "5": "invalid_json", "6": "invalid_json", "7": "unexpected:zz", "8": "type:c,type:l,type:t", "9": "unknown_tool"}
    expected = {"arguments": json.loads(arguments["1"]), "id": "1", "name": "f", "result": odd}
    assert rows["1"].message == json.dumps(expected, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(rows["5"].message) == {"arguments": None, "id": "5", "name": "f", "result": None}


def test_a_long_conversation_is_ordered(spark):
    n = 600
    calls = [(1, t, f"c{t}", "f", '{"a":1,"c":"$ref:c%d"}' % (t // 2) if t else '{"a":1}') for t in range(n)]
    rows = run(spark, calls, [(1, t + 1, f"c{t}", "r") for t in range(n)])
    place = {r.call_id: r.position for r in rows if r.kind == "call" and r.status != "missing_reference"}
    assert sorted(p for p in place.values() if p) == list(range(1, n + 1))
    assert all(place[f"c{t // 2}"] < place[f"c{t}"] for t in range(1, n))


def test_no_rows(spark):
    assert run(spark, [], []) == []
    assert [r.status for r in run(spark, [], [(1, 1, "x", "y")])] == ["orphan"]
