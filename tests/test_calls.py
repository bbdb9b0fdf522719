"""Single completion calls with retries, and fan-outs that are taken up again."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from flowloom.errors import ProviderError
from flowloom.operators import fan_out
from flowloom.operators.completion import CallRetry, call, from_wire, wire_message
from flowloom.queries import QUERIES


def flaky(failures, seen):
    def client(messages, config, attempt):
        seen.append((len(messages), config.get("temperature")))
        if attempt < len(failures):
            raise failures[attempt]
        return {"text": "fine"}

    return client


BUSY, NO, BAD = ProviderError("provider_rate_limit"), ProviderError("provider_authentication"), ProviderError("structured_output_invalid", "no object", "raw")


@pytest.mark.parametrize(
    "failures,retry,want,seen",
    [
        ([], CallRetry(1), (None, 1, []), [(1, 0.0)]),
        ([BUSY, BUSY], CallRetry(3), (None, 3, ["transient", "transient"]), [(1, 0.0)] * 3),
        ([BUSY] * 3, CallRetry(3), ("provider_rate_limit", 3, ["transient", "transient"]), [(1, 0.0)] * 3),
        ([NO], CallRetry(3), ("provider_authentication", 1, []), [(1, 0.0)]),
        ([BUSY, BUSY, BUSY], CallRetry(4, ({"temperature": 0.3}, {"temperature": 0.6})), (None, 4, ["transient"] * 3), [(1, 0.0), (1, 0.3), (1, 0.6), (1, 0.6)]),
        ([BAD], CallRetry(3), ("structured_output_invalid", 1, []), [(1, 0.0)]),
        ([BAD, BUSY], CallRetry(3, (), lambda raw, why: why), (None, 3, ["reask", "transient"]), [(1, 0.0), (3, 0.0), (3, 0.0)]),
    ],
)
def test_calls_are_repeated_only_where_it_helps(failures, retry, want, seen):
    log = []
    got = call(flaky(failures, log), [{"role": "user", "content": "x"}], {"temperature": 0.0}, retry)
    assert (got["category"], got["attempts"], got["reasons"]) == want and log == seen


def test_config_is_not_changed():
    base = {"temperature": 0.0, "seed": 1}
    assert CallRetry(2, ({"temperature": 0.5, "seed": None},)).config(base, 1) == {"temperature": 0.5, "seed": 1} and base["temperature"] == 0.0


def test_wire_messages(spark):
    df = spark.createDataFrame([("user", "é \"q\"", None), ("assistant", "", None), ("tool", "r", "t1")], "role string, content string, id string")
    wire = wire_message(F.col("role"), F.col("content"), F.col("id"))
    assert [r[0] for r in df.select(wire).collect()] == ['{"content":"é \\"q\\"","role":"user"}', '{"role":"assistant"}', '{"content":"r","role":"tool","tool_call_id":"t1"}']
    assert [tuple(r[0]) for r in df.select(from_wire(wire)).collect()] == [("user", 'é "q"', None), ("assistant", "", None), ("tool", "r", "t1")]


def test_messages_with_slashes_make_the_round_trip(spark, tmp_path):
    texts = ["plain", "see https://a.b/c", "</p>", 'a "quoted" \\ / text', None]
    rows = [(1, i, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["turn"]: (r["content"], r["wire_sha"]) for r in QUERIES["message_wire_round_trip"](spark, str(tmp_path)).collect()}
    wire = {i: json.dumps({"content": t, "role": "user"}, separators=(",", ":")) for i, t in enumerate(texts) if t is not None}
    assert {i: got[i] for i in wire} == {i: (texts[i], hashlib.sha256(w.encode()).hexdigest()) for i, w in wire.items()}
    assert set(got) == set(range(len(texts))) and got[4][0] == ""


def test_resumed_fan_out(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, ["d"])], "id int, items array<string>")
    saved = spark.createDataFrame([(1, 1, "saved"), (3, 0, None), (3, 4, "beyond")], "id int, fan_out_index int, out string")
    ran = []
    child = lambda df: df.withColumn("out", F.upper("item"))
    out = {r["id"]: r for r in fan_out.resumed(rows, "id", "items", saved, child, {"got": "out"}).collect()}
    assert out[1]["got"] == ["A", "saved", "C"] and not out[1]["changed"]
    assert out[2]["got"] == [] and not out[2]["changed"] and out[3]["got"][0] is None and out[3]["changed"]
    assert not ran
