"""Completion calls over tables: a client on the executors, with retries of single calls."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TRANSIENT_CATEGORIES, ProviderError
from ..sources.scratch import Scratch

#: client(messages, config, attempt) -> response text and counters, or raises ProviderError.
Client = Callable[[Sequence[Mapping], Mapping, int], Mapping]


@dataclass(frozen=True)
class CallRetry:
    """max_attempts in all; overrides: settings of the first, second, ... repetition, the last
    one going on; reask(raw, reason) -> correction for output that breaks its schema."""

    max_attempts: int = 3
    overrides: Sequence[Mapping] = ()
    reask: Callable[[str, str], str] | None = None

    def config(self, base: Mapping, attempt: int) -> dict:
        if not attempt or not self.overrides:
            return dict(base)
        more = self.overrides[min(attempt - 1, len(self.overrides) - 1)]
        return {**base, **{k: v for k, v in more.items() if v is not None}}


def call(client: Client, messages: Sequence[Mapping], config: Mapping, retry: CallRetry = CallRetry(1)) -> dict:
    """One logical call: text, category (null: success), attempts, config and retry reasons."""
    talk, reasons = list(messages), []
    for attempt in range(retry.max_attempts):
        used = retry.config(config, attempt)
        try:
            return {**client(talk, used, attempt), "category": None, "attempts": attempt + 1, "config": used, "reasons": reasons}
        except ProviderError as e:
            again = e.category in TRANSIENT_CATEGORIES
            if e.category == "structured_output_invalid" and retry.reask is not None:
                talk += [{"role": "assistant", "content": e.subject or ""}, {"role": "user", "content": retry.reask(e.subject or "", e.message)}]
                reasons.append("reask")
            elif again:
                reasons.append("transient")
            if attempt + 1 >= retry.max_attempts or not (again or reasons[attempt:] == ["reask"]):
                return {"text": None, "category": e.category, "attempts": attempt + 1, "config": used, "reasons": reasons[:attempt]}
    raise ValueError("max_attempts must be 1 or more")


def checked(client: Client, schema: Mapping) -> Client:
    """A client whose answers must be JSON of a schema; others are structured_output_invalid,
    which a retry may ask again for."""
    from ..functions.messages import check_schema, schema_violation

    check_schema(schema)

    def run(messages, config, attempt):
        got = client(messages, config, attempt)
        try:
            value = json.loads(got["text"])
        except (TypeError, ValueError):
            raise ProviderError("structured_output_invalid", "not JSON", got["text"]) from None
        bad = schema_violation(value, schema) if isinstance(value, dict) else "not an object"
        if bad:
            raise ProviderError("structured_output_invalid", bad, got["text"])
        return got

    return run


def with_tools(config: Mapping, tools: Sequence[Mapping] = (), tool_choice: str | Mapping | None = None, response_schema: Mapping | None = None) -> dict:
    """A call's settings with tools, their choice and a response schema, checked before any call."""
    from ..functions.messages import check_schema, check_tools, strict_supported

    check_tools([t["name"] for t in tools], tool_choice)
    out = dict(config)
    if tools:
        out["tools"] = [{"type": "function", "function": {k: t[k] for k in ("name", "description", "parameters") if k in t}} for t in tools]
        if tool_choice is not None:
            out["tool_choice"] = {"type": "function", "function": {"name": tool_choice["name"]}} if isinstance(tool_choice, Mapping) else tool_choice
    if response_schema is not None:
        check_schema(response_schema)
        out["response_format"] = {"type": "json_schema", "json_schema": {"name": "response", "schema": dict(response_schema), "strict": strict_supported(response_schema)}}
    return out


def completed(rows: DataFrame, client: Client, id_col: str, prompt_col: str, config: Mapping, retry: CallRetry = CallRetry(1), tools: Sequence[Mapping] = (), tool_choice: str | Mapping | None = None, response_schema: Mapping | None = None, concurrency: int | None = None) -> DataFrame:
    """id, text, category, attempts, temperature, reasons of one call per row, in Arrow batches.

    A task that is repeated calls again: give the client an idempotency key, the row's id.
    With a response schema answers are checked against it. `concurrency` bounds the calls that
    are under way at a time: so many tasks at most, each with a pool of its share of them.
    Results keep the order of the rows.
    """
    config = with_tools(config, tools, tool_choice, response_schema)
    if response_schema is not None:
        client = checked(client, response_schema)
    if concurrency is not None:
        if concurrency <= 0:
            raise ValueError("concurrency must be 1 or more")
        tasks = min(concurrency, rows.sparkSession.sparkContext.defaultParallelism)
        rows = rows.coalesce(tasks)
    share = 1 if concurrency is None else concurrency // tasks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(share) as pool:
            for pdf in batches:
                got = list(pool.map(lambda i, p: call(client, [{"role": "user", "content": p, "id": int(i)}], config, retry), pdf["id"], pdf["prompt"]))
                yield pd.DataFrame(
                    {
                        "id": pdf["id"], "text": [g["text"] for g in got], "category": [g["category"] for g in got], "attempts": [g["attempts"] for g in got],
                        "temperature": [g["config"].get("temperature") for g in got], "reasons": [",".join(g["reasons"]) for g in got],
                    }
                )

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(prompt_col).alias("prompt")).mapInPandas(run, "id long, text string, category string, attempts long, temperature double, reasons string")


def wire_message(role: Column, content: Column, tool_call_id: Column | None = None, tool_calls: Column | None = None, blocks: Column | None = None) -> Column:
    """A message as JSON for the wire; an assistant's empty content is null there.

    tool_calls: array of (id, name, arguments as JSON) of an assistant. blocks: array of
    (type, text, url) that replaces the content: text and image_url blocks.
    """
    text = F.when((role == "assistant") & (content == ""), F.lit(None)).otherwise(content)
    fields = {"content": text, "role": role}
    if blocks is not None:
        made = F.transform(
            blocks,
            lambda b: F.struct(
                F.when(b["type"] == "image", F.struct(b["url"].alias("url"))).alias("image_url"), F.when(b["type"] == "text", b["text"]).alias("text"),
                F.when(b["type"] == "image", "image_url").otherwise(b["type"]).alias("type"),
            ),
        )
        whole = F.to_json(F.struct(made.alias("content"), role.alias("role")))
    if tool_call_id is not None:
        fields["tool_call_id"] = F.when(role == "tool", tool_call_id)
    if tool_calls is not None:
        fields["tool_calls"] = F.when(
            (role == "assistant") & (F.size(tool_calls) > 0),
            F.transform(tool_calls, lambda c: F.struct(F.struct(c["arguments"].alias("arguments"), c["name"].alias("name")).alias("function"), c["id"].alias("id"), F.lit("function").alias("type"))),
        )
    plain = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))
    return plain if blocks is None else F.when(F.size(blocks) > 0, whole).otherwise(plain)


def from_wire(message: Column) -> Column:
    """role, content ('' for null), of a wire message; malformed JSON gives nulls."""
    m = F.from_json(message, "role string, content string, tool_call_id string")
    return F.struct(m["role"].alias("role"), F.when(m["role"].isNotNull(), F.coalesce(m["content"], F.lit(""))).alias("content"), m["tool_call_id"].alias("tool_call_id"))


def calls_from_wire(message: Column) -> Column:
    """Array of (id, name, arguments) of an assistant's wire message; null for others."""
    m = F.from_json(message, "tool_calls array<struct<id:string,function:struct<name:string,arguments:string>>>")
    return F.transform(m["tool_calls"], lambda c: F.struct(c["id"].alias("id"), c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments")))


def tool_loop(rows: DataFrame, step: Callable[[DataFrame], DataFrame], tools: Callable[[DataFrame], DataFrame], pending: Column, max_turns: int = 10) -> DataFrame:
    """Turns of model and tools until no row has pending tool calls.

    step asks the model for the rows that are still on their way, tools answers their calls;
    rows that are done leave the loop. Each turn is written to the shared folder. Rows that
    still have calls after max_turns come out as they are.
    """
    scratch, done, todo = Scratch(rows.sparkSession, "tools"), [], rows
    for turn in range(max_turns):
        table, n = scratch.counted(step(todo), F.coalesce(pending, F.lit(False)))
        done.append(table.where(~F.coalesce(pending, F.lit(False))))
        if not n or turn + 1 == max_turns:
            done.append(table.where(F.coalesce(pending, F.lit(False))))
            break
        todo = tools(table.where(pending))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
