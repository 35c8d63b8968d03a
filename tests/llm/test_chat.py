import json

from docspark.llm import chat
from docspark.llm.queries import TOOLS

ROWS = [
    (1, 0, "user", 'hi "x" / é\n'),
    (1, 3, "assistant", '{"tool_calls":[{"id":"a","name":"search","arguments":{"query":"q","limit":3}}],"content":"so"}'),
    (1, 2, "tool", '{"tool_call_id":"a","content":"r"}'),
    (1, 4, "assistant", '{"tool_calls":[{"id":"b","name":"search","arguments":{"query":"$a","limit":"x","zz":1}}]}'),
    (1, 5, "tool", '{"tool_call_id":"b","content":{"k":1}}'),
    (1, 5, "tool", '{"tool_call_id":"b","content":{"k":1}}'),
    (1, 6, "tool", '{"tool_call_id":"none"}'),
    (2, 0, None, None),
    (None, None, "user", "{not json"),
    (2, 1, "assistant", '{"tool_calls":[{"id":"x","name":"fetch","arguments":{"url":"$y"}},{"id":"y","name":"no","arguments":3}]}'),
    (2, 2, "assistant", '{"tool_calls":[{"id":"z","name":"fetch","arguments":{"headers":{}}}]}'),
    (3, 0, "user", "long " * 20_000),
]


def formatted(spark, rows=ROWS):
    schema = "conv_id long, turn long, role string, text string, calls string"
    df = spark.createDataFrame([(*r, "x") for r in rows], schema)
    return chat.format_chats(df, TOOLS)


def test_order_puts_results_behind_calls_and_calls_behind_needs(spark):
    rows = formatted(spark).where("conv_id = 1").orderBy("order_turn", "level", "turn").collect()
    assert [r.turn for r in rows] == [0, 3, 2, 4, 5, 5, 6]
    assert [r.linked for r in rows] == [None, None, True, None, True, True, False]


def test_arguments_are_checked(spark):
    rows = {(r.conv_id, r.turn): r for r in formatted(spark).where("n_calls > 0").collect()}
    assert rows[1, 3].valid and rows[1, 3].problems == ""
    assert rows[1, 4].problems == "type of limit; unexpected zz" and not rows[1, 4].valid
    assert rows[2, 1].problems == "unknown tool no"
    assert rows[2, 2].problems == "missing url"


def test_json_is_canonical_and_rows_are_kept(spark):
    rows = formatted(spark).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        value = json.loads(r.message)
        assert r.message == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert {json.loads(r.message)["content"] for r in rows if r.conv_id == 2 and r.turn == 0} == {""}


def test_every_field_of_a_message_is_kept(spark):
    texts = [
        ("assistant", '{"tool_calls":[{"id":"a","name":"fetch","arguments":"{no json"}],"content":"so","model":"m"}'),
        ("assistant", '{"tool_calls":[{"id":"b","name":"fetch","arguments":{"url":"x","url":"y"}}]}'),
        ("assistant", '{"tool_calls":[{"id":"c","type":"function","function":{"name":"fetch","arguments":"{\\"url\\":\\"u\\"}","strict":true}}]}'),
        ("tool", '{"tool_call_id":"a","result":{"z":[1,2],"b":null}}'),
        ("tool", '{"tool_call_id":"b","error":"no"}'),
        ("tool", '{"tool_call_id":"c","role":"user","output":1}'),
        ("assistant", '{"tool_calls":[{"id":"d","name":"fetch","function":"f"},"odd"]}'),
    ]
    rows = formatted(spark, [(1, i, *x) for i, x in enumerate(texts)]).orderBy("turn").collect()
    assert [r.message for r in rows] == [json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":")) for r in rows]
    got = [json.loads(r.message) for r in rows]
    assert got == [
        {"role": "assistant", "content": "so", "model": "m", "tool_calls": [{"id": "a", "name": "fetch", "arguments": "{no json"}]},
        {"role": "assistant", "raw": texts[1][1], "tool_calls": [{"id": "b", "name": "fetch", "arguments": '{"url":"x","url":"y"}'}]},
        {
            "role": "assistant",
            "tool_calls": [{"id": "c", "type": "function", "name": "fetch", "arguments": {"url": "u"}, "function": {"strict": True}}],
        },
        {"role": "tool", "tool_call_id": "a", "result": {"z": [1, 2], "b": None}},
        {"role": "tool", "tool_call_id": "b", "error": "no"},
        {"role": "tool", "tool_call_id": "c", "raw": texts[5][1]},
        {"role": "assistant", "raw": texts[6][1], "tool_calls": [{"id": "d", "name": "fetch"}]},
    ]
    assert rows[2].valid and [r.linked for r in rows[3:6]] == [True] * 3


def test_cycles_end(spark):
    call = lambda i, need: json.dumps({"tool_calls": [{"id": i, "name": "fetch", "arguments": {"url": need}}]})
    rows = [(1, 0, "assistant", call("p", "$q")), (1, 1, "assistant", call("q", "$p")), (1, 2, "assistant", call("r", "u"))]
    rows += [(1, 3 + i, "assistant", call(f"s{i}", f"$s{i - 1}" if i else "$r")) for i in range(4)]
    got = {r.turn: r.level for r in formatted(spark, rows).collect()}
    assert got[2] == 0 and [got[3 + i] for i in range(4)] == [2, 4, 6, 8]


def test_no_rows_and_no_python(spark):
    assert formatted(spark).where("false").count() == 0
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).count() == 0
    plan = formatted(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
