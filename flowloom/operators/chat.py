"""Completion calls on conversations: message rows in, answers with tool calls and usage out.

Requests are built and answers are read by native expressions; only the transport is Python,
on the executors. Each task keeps a bounded number of calls under way and gives their
results in the order of its rows. A conversation becomes one request, so its messages come
together in one row; what the provider's context takes bounds that.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TRANSIENT_CATEGORIES, ProviderError
from ..functions.messages import check_schema, message_error
from ..sources.scratch import Scratch
from .completion import with_tools, wire_message
from .typed_events import call_events

#: transport(request body as JSON, attempt from 0) -> response body as JSON, or raises
#: ProviderError; its `retry_after` (seconds), if it has one, is waited for.
Transport = Callable[[str, int], str]
CALLS = "array<struct<id: string, name: string, arguments: string>>"
#: Reasons an answer may end for; the old name of tool calls is renamed, others are errors.
FINISHED = ("stop", "length", "tool_calls", "content_filter", "error")


def requests(messages: DataFrame, config: Mapping, conversation: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", tools: Sequence[Mapping] = (), tool_choice=None, response_schema: Mapping | None = None) -> DataFrame:
    """id, body (JSON; null if invalid), category, message for each conversation.

    messages may have tool_call_id and tool_calls (array of id, name, arguments as JSON).
    They go by turn. A conversation whose messages break a rule, its list or one of its
    messages, is provider_invalid_request and is never sent; settings are checked at once.
    """
    if response_schema is not None:
        check_schema(response_schema)
    settings = with_tools(config, tools, tool_choice, response_schema)
    call_id = F.col("tool_call_id") if "tool_call_id" in messages.columns else F.lit(None).cast("string")
    calls = F.col("tool_calls").cast(CALLS) if "tool_calls" in messages.columns else F.lit(None).cast(CALLS)
    own = messages.select(
        F.col(conversation).alias("id"), F.col(turn).alias("turn"), F.col(role).alias("role"), wire_message(F.col(role), F.col(content), call_id, calls).alias("wire"),
        message_error(F.col(role), F.col(content), calls, call_id).alias("bad"), call_id.alias("answers"), F.transform(calls, lambda c: c["id"]).alias("asked"),
    )
    talk = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "wire", "bad", "answers", "asked")), lambda a, b: F.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(0)).alias("m"))
    roles = F.transform("m", lambda x: x["role"])
    known = F.aggregate("m", F.array().cast("array<string>"), lambda a, x: F.concat(a, F.coalesce(x["asked"], F.array().cast("array<string>"))))
    lost = F.exists("m", lambda x: (x["role"] == "tool") & x["answers"].isNotNull() & ~F.array_contains(known, x["answers"]))
    wrong = (
        F.when(~F.coalesce(roles[0].isin("system", "user"), F.lit(False)), "first_role")
        .when(F.exists(F.slice(roles, 2, F.greatest(F.size(roles) - 1, F.lit(0))), lambda r: r == "system"), "system_late")
        .when(~F.coalesce(F.element_at(roles, -1).isin("user", "tool"), F.lit(False)), "last_role")
        .otherwise(F.coalesce(F.get(F.filter(F.transform("m", lambda x: x["bad"]), lambda b: b.isNotNull()), F.lit(0)), F.when(lost, "tool_call_id")))
    )
    head = json.dumps(settings, sort_keys=True, separators=(",", ":"))[1:-1]
    body = F.concat(F.lit("{" + head + ("," if head else "") + '"messages":['), F.array_join(F.transform("m", lambda x: x["wire"]), ","), F.lit("]}"))
    return talk.select("id", wrong.alias("message"), body.alias("body")).select(
        "id", F.when(F.col("message").isNull(), F.col("body")).alias("body"), F.when(F.col("message").isNotNull(), "provider_invalid_request").alias("category"), "message"
    )


def _attempts(transport: Transport, body: str | None, most: int, base: float, cap: float, waits: random.Random) -> tuple:
    """(raw answer, category, message, attempts, latency in ms) of a call, repeated while its errors are transient."""
    began, k = time.monotonic(), 0
    if body is None:
        return None, None, None, 0, 0.0
    while True:
        try:
            return transport(body, k), None, None, k + 1, (time.monotonic() - began) * 1000
        except ProviderError as e:
            k += 1
            if e.category not in TRANSIENT_CATEGORIES or k >= most:
                return None, e.category, e.message, k, (time.monotonic() - began) * 1000
            after = getattr(e, "retry_after", None)
            time.sleep(after if after is not None else waits.uniform(0, min(cap, base * 2.0 ** (k - 1))))


def called(asked: DataFrame, transport: Transport, attempts: int = 1, concurrency: int | None = 10, tasks: int | None = None, base: float = 1.0, cap: float = 30.0) -> DataFrame:
    """asked with raw (the answer's JSON), category, message, attempts and latency_ms.

    `concurrency` bounds the calls under way at a time in the whole job: the rows are dealt
    to so many tasks at most, and each keeps its share of the calls under way, in a pool of
    its own; None: no bound, a task still waits for one call at a time. Waits between
    attempts are uniform below base * 2 ** k seconds, cap at most, or what the error's
    retry_after says. A task that is repeated calls again; the id in the body tells a
    provider so.
    """
    if concurrency is not None and concurrency <= 0:
        raise ValueError("concurrency must be 1 or more")
    if attempts < 1:
        raise ValueError("attempts must be 1 or more")
    parts = asked.sparkSession.sparkContext.defaultParallelism if tasks is None else tasks
    if concurrency is not None:
        parts = max(1, min(parts, concurrency))
        asked = asked.repartition(parts, "id")
    share = 1 if concurrency is None else max(1, concurrency // parts)
    kept = [c for c in asked.columns if c not in ("category", "message")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema if f.name in kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waits = random.Random()
        with ThreadPoolExecutor(share) as pool:
            for pdf in batches:
                got = list(pool.map(lambda b: _attempts(transport, b, attempts, base, cap, waits), pdf["body"].where(pdf["body"].notna(), None)))
                out = pd.DataFrame(got, columns=["raw", "_c", "_m", "attempts", "latency_ms"], index=pdf.index)
                refused = pdf["category"].notna()
                out["category"], out["message"] = pdf["category"].where(refused, out["_c"]), pdf["message"].where(refused, out["_m"])
                yield pd.concat([pdf[kept], out[["raw", "category", "message", "attempts", "latency_ms"]]], axis=1)

    return asked.mapInPandas(run, f"{kinds}, raw string, category string, message string, attempts long, latency_ms double")


_ANSWER = "choices array<struct<message: struct<content: string, tool_calls: array<struct<id: string, function: struct<name: string, arguments: string>>>>, finish_reason: string>>, id string, model string"


def _counted(v: Column, path: str) -> Column:
    """A whole number from 0 below a VARIANT, else null: no text, no fraction."""
    n = F.try_variant_get(v, path, "bigint")
    return F.when((F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BIGINT") & (n >= 0), n)


def answers(calls: DataFrame) -> DataFrame:
    """calls with content, finish_reason, tool_calls, the usage's counters, response_id and model, without raw.

    An answer that lacks its message or reason, or whose tool calls have no id, name or JSON
    object as arguments, is provider_invalid_response; under the reason error bad arguments
    are null instead. Counters that aren't whole numbers from 0 are null, not 0.
    """
    a = F.from_json("raw", _ANSWER)
    first = F.get(a["choices"], F.lit(0))
    out = calls.withColumns({"_a": a, "_first": first, "_v": F.try_parse_json("raw")})
    said = F.col("_first")["finish_reason"]
    reason = F.when(said == "function_call", "tool_calls").when(said.isin(*FINISHED), said).otherwise("error")
    wire = F.col("_first")["message"]["tool_calls"]
    is_object = lambda t: F.coalesce(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), F.lit(False))
    read = F.transform(wire, lambda c: F.struct(c["id"].alias("id"), c["function"]["name"].alias("name"), F.when(is_object(c["function"]["arguments"]), c["function"]["arguments"]).alias("arguments")))
    broken = F.exists(read, lambda c: c["id"].isNull() | c["name"].isNull() | (c["arguments"].isNull() & (reason != "error")))
    bad = F.col("raw").isNotNull() & (F.col("_first")["message"].isNull() | said.isNull() | F.coalesce(broken, F.lit(False)))
    ok = F.col("raw").isNotNull() & ~bad
    usage = {k: F.when(ok, _counted(F.col("_v"), f"$.usage.{k}")).alias(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens")}
    rest = [c for c in calls.columns if c not in ("raw", "category", "message")]
    return out.select(
        *rest, F.coalesce("category", F.when(bad, "provider_invalid_response")).alias("category"), F.coalesce("message", F.when(bad, "message, reason or tool calls can't be read")).alias("message"),
        F.when(ok, F.coalesce(F.col("_first")["message"]["content"], F.lit(""))).alias("content"), F.when(ok, reason).alias("finish_reason"), F.when(ok, read).alias("tool_calls"),
        *usage.values(), F.when(ok, F.col("_a")["id"]).alias("response_id"), F.when(ok, F.col("_a")["model"]).alias("model"),
    )


def complete(messages: DataFrame, transport: Transport, config: Mapping, conversation: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", tools: Sequence[Mapping] = (), tool_choice=None, response_schema: Mapping | None = None, **options) -> DataFrame:
    """One call a conversation: id, attempts, latency_ms, category, message, content, finish_reason, tool_calls, usage, response_id, model.

    With a response schema an answer that isn't a tool call must match it, else it is
    structured_output_invalid; its usage and reason stay.
    """
    asked = requests(messages, config, conversation, turn, role, content, tools, tool_choice, response_schema)
    out = answers(called(asked, transport, **options)).drop("body")
    if response_schema is None:
        return out
    from ..functions.json_schema import schema_check

    why = F.when(F.col("category").isNull() & (F.col("finish_reason") != "tool_calls"), schema_check(response_schema)(F.col("content")))
    return out.withColumn("_why", why).withColumns({"category": F.coalesce("category", F.when(F.col("_why").isNotNull(), "structured_output_invalid")), "message": F.coalesce("message", "_why")}).drop("_why")


def next_turns(messages: DataFrame, done: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """The assistant's rows that answers add behind each conversation's last turn."""
    last = messages.groupBy(F.col(conversation).alias("id")).agg((F.max(turn) + 1).alias("_turn"))
    good = done.where("category is null").join(last, "id")
    return good.select(
        F.col("id").alias(conversation), F.col("_turn").alias(turn), F.lit("assistant").alias(role), F.col("content").alias(content), F.lit(None).cast("string").alias("tool_call_id"), F.col("tool_calls").cast(CALLS).alias("tool_calls")
    )


def completion_events(done: DataFrame, at: str, invocation: str = "id") -> DataFrame:
    """The event of each call, with usage, reason, attempts and model."""
    carried = ("prompt_tokens", "completion_tokens", "total_tokens", "finish_reason", "attempts", "model")
    return call_events(done, "llm", invocation, at, attributes={c: c for c in carried})


def converse(messages: DataFrame, transport: Transport, answer_tools: Callable[[DataFrame], DataFrame], config: Mapping, tools: Sequence[Mapping], max_turns: int = 10, conversation: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", **options) -> tuple[DataFrame, DataFrame]:
    """Calls and tool answers until no conversation waits for a tool: (all messages, all calls with their round).

    answer_tools takes rows (conversation, tool_call_id, name, arguments) and returns
    (conversation, tool_call_id, content). Conversations that are done aren't sent again;
    those that still ask after max_turns stay as they are. Each round is written to the
    shared folder: its calls aren't made twice for what follows.
    """
    scratch = Scratch(messages.sparkSession, "talk")
    shape = [conversation, turn, role, content, "tool_call_id", "tool_calls"]
    have = {"tool_call_id": F.lit(None).cast("string"), "tool_calls": F.lit(None).cast(CALLS)}
    talk = scratch.save(messages.withColumns({c: v for c, v in have.items() if c not in messages.columns}).select(*shape))
    active, calls = talk, None
    waiting = F.col("category").isNull() & (F.coalesce(F.size("tool_calls"), F.lit(0)) > 0)
    for k in range(max_turns):
        done, n = scratch.counted(complete(active, transport, config, conversation, turn, role, content, tools, **options).withColumn("round", F.lit(k)), waiting)
        calls = done if calls is None else calls.unionByName(done)
        said = next_turns(active, done, conversation, turn, role, content)
        asked = said.where(F.size("tool_calls") > 0).select(conversation, F.col(turn).alias("_since"), F.posexplode("tool_calls").alias("_k", "_c"))
        asked = asked.select(conversation, "_since", "_k", F.col("_c.id").alias("tool_call_id"), F.col("_c.name").alias("name"), F.col("_c.arguments").alias("arguments"))
        got = answer_tools(asked.select(conversation, "tool_call_id", "name", "arguments")).select(F.col(conversation).alias("_conv"), F.col("tool_call_id").alias("_id"), F.col(content).alias("_said"))
        told = asked.join(got, (F.col(conversation) == F.col("_conv")) & (F.col("tool_call_id") == F.col("_id")), "left").select(
            conversation, (F.col("_since") + 1 + F.col("_k")).alias(turn), F.lit("tool").alias(role), F.coalesce("_said", F.lit("no answer")).alias(content), "tool_call_id", F.lit(None).cast(CALLS).alias("tool_calls")
        )
        added = scratch.save(said.unionByName(told))
        talk = talk.unionByName(added)
        if not n:
            break
        going = done.where(waiting).select(F.col("id").alias(conversation))
        active = scratch.save(active.unionByName(added).join(going, conversation, "left_semi").select(*shape))
    return talk, calls
