"""Calls of many inputs: requests across batches, usage, failures, order."""

import json

import pytest
from pyspark.sql import functions as F

from flowloom.errors import ProviderError
from flowloom.operators import calls as C


def echo(texts):
    return {"entries": [(i, [float(len(t)), float(len(texts))]) for i, t in enumerate(texts)][::-1], "tokens": len(texts), "id": texts[0], "model": "m"}


def inputs(spark, counts, text=lambda c, k: f"{c}{'x' * k}"):
    return spark.createDataFrame([(c, k, text(c, k), f"q{c}") for c, n in counts.items() for k in range(n)], "call string, place long, text string, asked string")


@pytest.mark.parametrize("batch", ["2", "1000"])
def test_requests_hold_cap_inputs_of_one_call_whatever_the_batches(spark, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        vectors, calls = C.embed_calls(inputs(spark, {"a": 11, "b": 4, "c": 1}).repartition(3), echo, "call", "place", "text", 4)
        got = {(r["call"], r["place"]): r["vector"] for r in vectors.collect()}
        sums = {r["call"]: (r["inputs"], r["requests"], r["tokens"], r["response_id"], r["model"], r["category"]) for r in calls.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(c, k): [float(1 + k), float(min(4, n - k // 4 * 4))] for c, n in {"a": 11, "b": 4, "c": 1}.items() for k in range(n)}
    assert sums == {"a": (11, 3, 11, "a", "m", None), "b": (4, 1, 4, "b", "m", None), "c": (1, 1, 1, "c", "m", None)}


def test_one_bad_request_fails_its_call_only(spark):
    def client(texts):
        if texts[0].startswith("down"):
            raise ProviderError("provider_unavailable", "no")
        if texts[0].startswith("short"):
            return {"entries": [(0, [1.0])] * len(texts)}
        if texts[0].startswith("odd"):
            return {"entries": [(i, [0.0] * len(texts)) for i in range(len(texts))], "tokens": 1}
        return echo(texts) | ({"tokens": "3"} if texts[0].startswith("quiet") else {})

    counts = {"fine": 3, "down": 3, "short": 3, "odd": 3, "quiet": 3, "empty": 3}
    rows = inputs(spark, counts, lambda c, k: "" if c == "empty" and k == 2 else f"{c}{k}").unionByName(spark.createDataFrame([("none", 0, None, "q")], "call string, place long, text string, asked string"))
    vectors, calls = C.embed_calls(rows, client, "call", "place", "text", 2)
    got = {r["call"]: (r["category"], r["tokens"]) for r in calls.collect()}
    assert got == {
        "fine": (None, 3), "down": ("provider_unavailable", None), "short": ("provider_invalid_response", None), "odd": ("provider_invalid_response", None), "quiet": (None, None),
        "empty": ("provider_invalid_request", None), "none": ("provider_invalid_request", None),
    }
    assert {r["call"] for r in vectors.collect()} == {"fine", "quiet"}
    events = {r["invocation_id"]: (r["kind"], json.loads(r["attributes"]).get("input_tokens")) for r in C.provider_events(calls.withColumn("at", F.current_timestamp()), "embedding", "at").collect()}
    assert len(events) == 7 and events["fine"] == ("embedding", 3) and events["down"] == ("embedding_failed", None)
    empty, none = C.embed_calls(rows.where("false"), client, "call", "place", "text", 2)
    assert empty.count() == none.count() == 0
    with pytest.raises(ValueError):
        C.embed_calls(rows, client, "call", "place", "text", 0)


def test_transient_failures_are_waited_for(spark, tmp_path):
    def client(texts):
        path = tmp_path / texts[0]
        tries = int(path.read_text()) if path.exists() else 0
        path.write_text(str(tries + 1))
        if tries < 2:
            raise ProviderError("provider_rate_limit", "busy")
        return echo(texts)

    _, calls = C.embed_calls(inputs(spark, {"a": 2}), client, "call", "place", "text", 2, attempts=3, base=0.001)
    assert calls.first()["category"] is None and (tmp_path / "a").read_text() == "3"
    _, calls = C.embed_calls(inputs(spark, {"b": 2}), client, "call", "place", "text", 2, attempts=2, base=0.001)
    assert calls.first()["category"] == "provider_rate_limit"


def test_ranks_are_of_the_whole_call(spark):
    def client(asked, documents):
        if asked == "qno":
            return {"entries": [(0, 1.0), (0, 2.0)]}
        return {"entries": [(i, float(len(d) % 5)) for i, d in enumerate(documents) if i != 1], "tokens": len(documents)}

    ranked, calls = C.rerank_calls(inputs(spark, {"a": 9, "no": 2}), client, "call", "asked", "place", "text", 4, 3)
    scores = {k: float((1 + k) % 5) for k in range(9) if k % 4 != 1}
    want = sorted(scores, key=lambda k: (-scores[k], k))[:3]
    assert [(r["place"], r["score"]) for r in ranked.orderBy("rank").collect()] == [(k, scores[k]) for k in want]
    assert {r["call"]: (r["tokens"], r["category"]) for r in calls.collect()} == {"a": (9, None), "no": (None, "provider_invalid_response")}
