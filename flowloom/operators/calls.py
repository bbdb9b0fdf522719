"""Embedding and reranking calls of any number of inputs: cut into requests, stitched natively.

A row is one input: its call, its place in the call (from 0) and its text. Requests hold
`cap` inputs of one call, by place; they are dealt by call and request, so a call with any
number of inputs spreads over tasks, and a request is put together across Arrow batches.
What belongs to a call as a whole is one aggregation over its requests: usage is their sum
only if each has reported it, id and model are the first's, and one failed request fails the
call.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TRANSIENT_CATEGORIES, ProviderError
from ..sources.scratch import Scratch
from .ranking import top_k as best
from .typed_events import call_events

#: client(texts) -> {"entries": [(index, vector)], "tokens": n or None, "id", "model"}.
EmbedClient = Callable[[Sequence[str]], Mapping]
#: client(query, documents) -> {"entries": [(index, score)], "tokens": n or None, "id", "model"}.
RerankClient = Callable[[str, Sequence[str]], Mapping]

_REQUEST = "call string, request long, n long, tokens long, response_id string, model string, category string, message string, latency_ms double"


def _tried(send: Callable[[], Mapping], attempts: int, base: float, cap: float, waits: random.Random) -> Mapping:
    for k in range(attempts):
        try:
            return send()
        except ProviderError as e:
            if e.category not in TRANSIENT_CATEGORIES or k + 1 == attempts:
                raise
            after = getattr(e, "retry_after", None)
            time.sleep(after if after is not None else waits.uniform(0, min(cap, base * 2.0**k)))
    raise ValueError("attempts must be 1 or more")


def _counted(tokens) -> int | None:
    return tokens if isinstance(tokens, int) and not isinstance(tokens, bool) and tokens >= 0 else None


def _requests(rows: DataFrame, call: str, place: str, text: str, cap: int, *more: str) -> DataFrame:
    """Inputs in the order of call, request and place; a request's rows are in one partition."""
    if cap < 1:
        raise ValueError("cap must be 1 or more")
    own = rows.select(F.col(call).cast("string").alias("call"), F.floor(F.col(place) / cap).cast("long").alias("request"), F.col(place).cast("long").alias("place"), F.col(text).cast("string").alias("text"), *more)
    return own.repartition("call", "request").sortWithinPartitions("call", "request", "place")


def _by_request(answer: Callable[[pd.DataFrame], tuple[Mapping, list]], columns: list[str]):
    """mapInPandas over inputs in order: answer() of each whole request, across batches."""

    def send(part: pd.DataFrame) -> dict:
        head = part.iloc[0]
        out = {"call": head["call"], "request": head["request"], "n": len(part), "tokens": None, "response_id": None, "model": None, "category": None, "message": None, "results": None}
        begun = time.monotonic()
        try:
            got, results = answer(part)
            out |= {"tokens": _counted(got.get("tokens")), "response_id": got.get("id"), "model": got.get("model"), "results": results}
        except ProviderError as e:
            out |= {"category": e.category, "message": e.message}
        return out | {"latency_ms": (time.monotonic() - begun) * 1000}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pd.concat([held, pdf], ignore_index=True) if held is not None else pdf
            if not len(pdf):
                continue
            number = ((pdf["call"] != pdf["call"].shift()) | (pdf["request"] != pdf["request"].shift())).cumsum()
            last = number.iloc[-1]
            held = pdf[number == last]
            done = [send(part) for _, part in pdf[number < last].groupby(number[number < last])]
            if done:
                yield pd.DataFrame(done, columns=columns).astype({"tokens": "Int64"})
        if held is not None:
            yield pd.DataFrame([send(held)], columns=columns).astype({"tokens": "Int64"})

    return run


def _calls(done: DataFrame) -> DataFrame:
    """A row for each call: inputs, requests, tokens, response_id, model, category, message, latency_ms."""
    whole = F.count("tokens") == F.count("*")
    bad = F.min(F.when(F.col("category").isNotNull(), F.struct("request", "category", "message")))
    g = done.groupBy("call").agg(
        F.sum("n").alias("inputs"), F.count("*").alias("requests"), F.when(whole, F.sum("tokens")).alias("tokens"), F.min_by("response_id", "request").alias("response_id"),
        F.min_by("model", "request").alias("model"), bad.alias("_bad"), F.sum("latency_ms").alias("latency_ms"), F.min("width").alias("_lo"), F.max("width").alias("_hi"),
    )
    odd = F.col("_bad").isNull() & (F.col("_lo") != F.col("_hi"))
    category = F.coalesce(F.col("_bad.category"), F.when(odd, "provider_invalid_response"))
    none = lambda c: F.when(category.isNull(), F.col(c)).alias(c)
    return g.select(
        "call", "inputs", "requests", none("tokens"), none("response_id"), none("model"), category.alias("category"), F.coalesce(F.col("_bad.message"), F.when(odd, "vectors differ in length")).alias("message"), "latency_ms"
    )


def embed_calls(rows: DataFrame, client: EmbedClient, call: str, place: str, text: str, cap: int, attempts: int = 1, base: float = 1.0, most: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(call, place, vector) of the calls that went well, and a row for each call.

    A null or empty text is provider_invalid_request and isn't sent. A response must have an
    entry for each input, in any order, and all vectors of a call one length.
    """
    waits = random.Random()

    def answer(part: pd.DataFrame):
        texts = part["text"].tolist()
        if not all(isinstance(t, str) and t for t in texts):
            raise ProviderError("provider_invalid_request", "an input is empty")
        got = _tried(lambda: client(texts), attempts, base, most, waits)
        entries = sorted(got["entries"], key=lambda e: e[0])
        if [i for i, _ in entries] != list(range(len(texts))):
            raise ProviderError("provider_invalid_response", "indices aren't those of the inputs")
        if len({len(v) for _, v in entries}) > 1:
            raise ProviderError("provider_invalid_response", "vectors differ in length")
        return got, [{"place": p, "vector": [float(x) for x in v]} for p, (_, v) in zip(part["place"].tolist(), entries, strict=True)]

    kind = f"{_REQUEST}, results array<struct<place: long, vector: array<double>>>"
    names = [c.split()[0] for c in _REQUEST.split(", ")] + ["results"]
    done = Scratch(rows.sparkSession, "embed").save(_requests(rows, call, place, text, cap).mapInPandas(_by_request(answer, names), kind))
    calls = _calls(done.withColumn("width", F.size(F.get("results", F.lit(0))["vector"])))
    good = calls.where("category is null").select(F.col("call").alias("_c"))
    vectors = done.join(good, done["call"] == good["_c"]).select("call", F.explode("results").alias("r")).select("call", "r.place", "r.vector")
    return vectors, calls


def rerank_calls(rows: DataFrame, client: RerankClient, call: str, query: str, place: str, text: str, cap: int, top_k: int | None = None, attempts: int = 1, base: float = 1.0, most: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(call, place, score, rank) of the calls that went well, best first, and a row for each call.

    Scores of all requests of a call are ranked together, ties by place, before the cut. A
    null or empty query is provider_invalid_request; indices may be left out, but not repeat.
    """
    waits = random.Random()

    def answer(part: pd.DataFrame):
        asked, texts, places = part["_query"].iloc[0], ["" if t is None else t for t in part["text"]], part["place"].tolist()
        if not asked:
            raise ProviderError("provider_invalid_request", "the query is empty")
        got = _tried(lambda: client(asked, texts), attempts, base, most, waits)
        at = [i for i, _ in got["entries"]]
        if len(set(at)) < len(at) or any(not 0 <= i < len(texts) for i in at):
            raise ProviderError("provider_invalid_response", "indices repeat or lie outside")
        return got, [{"place": places[i], "score": float(x)} for i, x in got["entries"]]

    kind = f"{_REQUEST}, results array<struct<place: long, score: double>>"
    names = [c.split()[0] for c in _REQUEST.split(", ")] + ["results"]
    asked = _requests(rows.withColumn("_query", F.col(query).cast("string")), call, place, text, cap, "_query")
    done = Scratch(rows.sparkSession, "rerank").save(asked.mapInPandas(_by_request(answer, names), kind))
    calls = _calls(done.withColumn("width", F.lit(0)))
    good = calls.where("category is null").select(F.col("call").alias("_c"))
    scored = done.join(good, done["call"] == good["_c"]).select("call", F.explode("results").alias("r")).select("call", "r.place", "r.score")
    return best(scored, "call", "score", "place", top_k), calls


def provider_events(calls: DataFrame, what: str, at: str) -> DataFrame:
    """One event a call, embedding or rerank, with its usage."""
    return call_events(calls, what, "call", at, attributes={"input_tokens": "tokens", "inputs": "inputs", "requests": "requests", "model": "model"})
