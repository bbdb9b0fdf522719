"""Completion calls on conversations: requests, answers, tool rounds, retries, bounded pools."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from flowloom.errors import ProviderError
from flowloom.operators import chat

KIND = "conv_id long, turn long, role string, content string, tool_call_id string, tool_calls array<struct<id: string, name: string, arguments: string>>"


def talk(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], KIND)


def answer(content=None, reason="stop", calls=None, usage=None, **more):
    message = {"role": "assistant", "content": content}
    if calls:
        message["tool_calls"] = [{"id": i, "type": "function", "function": {"name": n, "arguments": a}} for i, n, a in calls]
    return json.dumps({"id": "r1", "model": "m", "choices": [{"message": message, "finish_reason": reason}], "usage": usage or {"prompt_tokens": 3, "completion_tokens": 1, "total_tokens": 4}, **more})


def test_requests_carry_whole_conversations_in_order_and_refuse_broken_ones(spark):
    call = [("c1", "look", '{"q":1}')]
    rows = talk(spark, [(1, 2, "user", 'say "é"'), (1, 1, "system", "Be brief."), (2, 1, "assistant", "Hi"), (2, 2, "user", "x"), (3, 1, "user", "a"), (3, 2, "system", "late"), (3, 3, "user", "b"),
                        (4, 1, "user", "a"), (4, 2, "assistant", "b"), (5, 1, "user", ""), (6, 1, "user", "q"), (6, 2, "assistant", "", None, call), (6, 3, "tool", "seen", "c1"), (7, 1, "user", "q"), (7, 2, "tool", "t", "c9"),
                        (8, 1, "bot", "q"), (9, 1, "user", "x")])
    tools = [{"name": "look", "description": "d", "parameters": {"type": "object"}}]
    got = {r["id"]: r for r in chat.requests(rows, {"model": "m", "temperature": 0.5}, tools=tools, tool_choice="auto").collect()}
    body = json.loads(got[1]["body"])
    assert body["messages"] == [{"role": "system", "content": "Be brief."}, {"role": "user", "content": 'say "é"'}] and (body["model"], body["temperature"], body["tool_choice"]) == ("m", 0.5, "auto")
    assert body["tools"][0]["function"]["name"] == "look"
    six = json.loads(got[6]["body"])["messages"]
    assert six[1]["tool_calls"] == [{"id": "c1", "type": "function", "function": {"name": "look", "arguments": '{"q":1}'}}] and six[1].get("content") is None and six[2]["tool_call_id"] == "c1"
    assert {i: r["message"] for i, r in got.items()} == {1: None, 2: "first_role", 3: "system_late", 4: "last_role", 5: "content_empty", 6: None, 7: "tool_call_id", 8: "first_role", 9: None}
    assert all((r["body"] is None) == (r["category"] == "provider_invalid_request") for r in got.values())
    assert json.loads(chat.requests(rows.where("conv_id = 9"), {}).first()["body"]) == {"messages": [{"role": "user", "content": "x"}]}
    with pytest.raises(ProviderError):
        chat.requests(rows, {}, tools=[], tool_choice="required")


def test_answers_are_read_natively(spark):
    cases = [
        answer("hello"), answer(None, "tool_calls", [("c", "look", "{}")]), answer("x", "function_call"), answer("x", "odd"), answer(None, "tool_calls", [("c", "look", "[1]")]),
        answer(None, "error", [("c", "look", "broken")]), json.dumps({"choices": []}), "no JSON", answer("u", usage={"prompt_tokens": "3", "completion_tokens": -1, "total_tokens": 2.5}),
        json.dumps({"choices": [{"message": {"content": "n"}, "finish_reason": "length"}]}), None,
    ]
    df = spark.createDataFrame([(i, raw, None, None) for i, raw in enumerate(cases)], "id long, raw string, category string, message string")
    got = [r for r in chat.answers(df).orderBy("id").collect()]
    assert [r["finish_reason"] for r in got] == ["stop", "tool_calls", "tool_calls", "error", None, "error", None, None, "stop", "length", None]
    assert [r["category"] for r in got] == [None] * 4 + ["provider_invalid_response", None] + ["provider_invalid_response"] * 2 + [None, None, None]
    assert got[0]["content"] == "hello" and (got[0]["prompt_tokens"], got[0]["total_tokens"], got[0]["response_id"], got[0]["model"]) == (3, 4, "r1", "m")
    assert [tuple(c) for c in got[1]["tool_calls"]] == [("c", "look", "{}")] and got[1]["content"] == "" and got[5]["tool_calls"][0]["arguments"] is None
    assert (got[8]["prompt_tokens"], got[8]["completion_tokens"], got[8]["total_tokens"]) == (None, None, None) and got[9]["prompt_tokens"] is None


def test_calls_are_repeated_only_while_errors_are_transient(spark):
    def transport(body, attempt):
        text = json.loads(body)["messages"][0]["content"]
        if text == "denied" or (text == "busy" and attempt < 2) or text == "down":
            e = ProviderError("provider_authentication" if text == "denied" else "provider_rate_limit", "no")
            e.retry_after = 0.01
            raise e
        return answer(f"{text} {attempt}")

    rows = talk(spark, [(1, 1, "user", "fine"), (2, 1, "user", "busy"), (3, 1, "user", "denied"), (4, 1, "user", "down"), (5, 1, "tool", "x")])
    out = chat.complete(rows, transport, {}, attempts=3, base=0.001)
    got = {r["id"]: (r["content"], r["category"], r["attempts"]) for r in out.collect()}
    assert got == {1: ("fine 0", None, 1), 2: ("busy 2", None, 3), 3: (None, "provider_authentication", 1), 4: (None, "provider_rate_limit", 3), 5: (None, "provider_invalid_request", 0)}
    events = {r["invocation_id"]: (r["kind"], json.loads(r["attributes"])["total_tokens"]) for r in chat.completion_events(out.withColumn("at", F.lit("2024-01-01").cast("timestamp")), "at").where("invocation_id < 3").collect()}
    assert events == {"1": ("llm_completion", 4), "2": ("llm_completion", 4)}
    assert chat.complete(rows.where("false"), transport, {}).count() == 0
    for bad in ({"concurrency": 0}, {"attempts": 0}):
        with pytest.raises(ValueError):
            chat.called(chat.requests(rows, {}), transport, **bad)


def test_a_pool_keeps_its_share_under_way_and_the_order_of_rows(spark, tmp_path):
    def transport(body, attempt):
        with open(tmp_path / f"{threading.get_ident()}-{time.monotonic_ns()}", "w") as f:
            begun = time.monotonic()
            time.sleep(0.05)
            f.write(f"{begun} {time.monotonic()}")
        return answer(json.loads(body)["messages"][0]["content"])

    rows = talk(spark, [(k, 1, "user", f"t{k}") for k in range(24)])
    out = chat.complete(rows, transport, {}, concurrency=6, tasks=2).collect()
    assert {r["id"]: r["content"] for r in out} == {k: f"t{k}" for k in range(24)}
    spans = [tuple(map(float, p.read_text().split())) for p in tmp_path.iterdir()]
    most = max(sum(a <= x < b for a, b in spans) for x, _ in spans)
    assert len(spans) == 24 and 2 <= most <= 6


def test_conversations_go_on_until_no_tool_is_asked_for(spark):
    def transport(body, attempt):
        said = json.loads(body)["messages"]
        tools = [m for m in said if m["role"] == "tool"]
        want = int(said[0]["content"])
        if len(tools) < want:
            calls = [(f"c{len(said)}-{k}", "double", json.dumps({"x": len(tools) + k})) for k in range(min(2, want - len(tools)))]
            return answer(None, "tool_calls", calls)
        return answer("+".join(m["content"] for m in tools))

    def double(asked):
        return asked.select("conv_id", "tool_call_id", (F.get_json_object("arguments", "$.x").cast("long") * 2).cast("string").alias("content"))

    tools = [{"name": "double", "parameters": {"type": "object"}}]
    rows = talk(spark, [(1, 1, "user", "0"), (2, 1, "user", "3"), (3, 5, "user", "1"), (4, 1, "assistant", "x")])
    messages, calls = chat.converse(rows, transport, double, {}, tools)
    last = {r["conv_id"]: r["content"] for r in messages.groupBy("conv_id").agg(F.max_by("content", "turn").alias("content")).collect()}
    assert last == {1: "", 2: "0+2+4", 3: "0", 4: "x"}
    assert sorted((r["id"], r["round"]) for r in calls.collect()) == [(1, 0), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (4, 0)]
    two = [(r["turn"], r["role"]) for r in messages.where("conv_id = 2").orderBy("turn").collect()]
    assert two == [(1, "user"), (2, "assistant"), (3, "tool"), (4, "tool"), (5, "assistant"), (6, "tool"), (7, "assistant")]
    _, cut = chat.converse(rows, transport, double, {}, tools, max_turns=1)
    assert cut.count() == 4


def test_answers_must_match_a_response_schema(spark):
    schema = {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}
    rows = talk(spark, [(1, 1, "user", '{"n": 1}'), (2, 1, "user", '{"n": "x"}'), (3, 1, "user", "no")])
    out = {r["id"]: (r["category"], r["message"], r["total_tokens"]) for r in chat.complete(rows, lambda b, k: answer(json.loads(b)["messages"][0]["content"]), {}, response_schema=schema).collect()}
    assert out == {1: (None, None, 4), 2: ("structured_output_invalid", "n: not integer", 4), 3: ("structured_output_invalid", "not JSON", 4)}
