"""Rules of message lists, tools and structured output."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ProviderError

ROLES = ("system", "user", "assistant", "tool")


def message_error(role: Column, content: Column, tool_calls: Column | None = None, tool_call_id: Column | None = None) -> Column:
    """What is wrong with a single message, or null."""
    empty = F.coalesce(content == "", F.lit(True))
    calls = F.coalesce(F.size(tool_calls) > 0, F.lit(False)) if tool_calls is not None else F.lit(False)
    named = tool_call_id.isNotNull() if tool_call_id is not None else F.lit(True)
    return (
        F.when(~F.coalesce(role.isin(*ROLES), F.lit(False)), "role")
        .when(role.isin("system", "user") & empty, "content_empty")
        .when((role == "assistant") & empty & ~calls, "assistant_empty")
        .when((role == "tool") & ~named, "tool_call_id")
    )


def list_errors(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """A row for each conversation: its flags, and the first rule it breaks (null: none).

    first_role: system or user; system_late: a system message that isn't first; last_role:
    user or tool. One aggregation with partial results; no window over a conversation.
    """
    first, last = F.min_by(role, turn), F.max_by(role, turn)
    late = F.sum(F.when(F.col(role) == "system", 1).otherwise(0)) - F.when(first == "system", 1).otherwise(0)
    g = messages.groupBy(conversation).agg(first.alias("first_role"), last.alias("last_role"), late.cast("long").alias("late_systems"), F.count("*").alias("n_messages"))
    broken = (
        F.when(~F.col("first_role").isin("system", "user"), "first_role").when(F.col("late_systems") > 0, "system_late").when(~F.col("last_role").isin("user", "tool"), "last_role")
    )
    return g.withColumn("error", broken)


def unmatched_tool_messages(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Tool messages whose tool_call_id no earlier assistant message of the conversation has.

    messages: conversation, turn, role, tool_call_ids (array, of assistants), tool_call_id. A
    call's first turn is found per (conversation, id), so no conversation is gathered.
    """
    calls = (
        messages.where(F.col("role") == "assistant").select(conversation, turn, F.explode("tool_call_ids").alias("tool_call_id")).groupBy(conversation, "tool_call_id").agg(F.min(turn).alias("_since"))
    )
    tools = messages.where(F.col("role") == "tool").select(conversation, turn, "tool_call_id")
    return tools.join(calls, [conversation, "tool_call_id"], "left").where(F.col("_since").isNull() | (F.col("_since") >= F.col(turn))).select(conversation, turn, "tool_call_id")


def check_tools(names: Sequence[str], choice: str | Mapping | None = None) -> None:
    """Unique tool names; a choice that needs a tool must find it."""
    if len(set(names)) != len(names):
        raise ProviderError("provider_invalid_request", "duplicate tool names")
    if choice in (None, "auto", "none"):
        return
    if not names:
        raise ProviderError("provider_invalid_request", "a tool is required but none is given")
    if isinstance(choice, Mapping) and choice.get("name") not in names:
        raise ProviderError("provider_invalid_request", f"no tool {choice.get('name')}")


def check_schema(schema: Mapping) -> None:
    """A response schema: a top-level object whose local references resolve."""
    if not isinstance(schema, Mapping) or schema.get("type") != "object":
        raise ProviderError("provider_invalid_request", "the response schema must be an object")

    def walk(node) -> None:
        if isinstance(node, Mapping):
            ref = node.get("$ref")
            if isinstance(ref, str):
                at = schema
                for part in ref.removeprefix("#/").split("/") if ref.startswith("#/") else [None]:
                    if not isinstance(at, Mapping) or part not in at:
                        raise ProviderError("provider_invalid_request", f"reference {ref} leads nowhere")
                    at = at[part]
            for v in node.values():
                walk(v)
        elif isinstance(node, (list, tuple)):
            for v in node:
                walk(v)

    walk(schema)


def strict_supported(schema: Mapping) -> bool:
    """Whether all objects close their properties and require each of them."""
    if isinstance(schema, Mapping):
        if schema.get("type") == "object" or "properties" in schema:
            props = schema.get("properties", {})
            if schema.get("additionalProperties") is not False or set(schema.get("required", ())) != set(props):
                return False
        return all(strict_supported(v) for v in schema.values() if isinstance(v, (Mapping, list)))
    return all(strict_supported(v) for v in schema if isinstance(v, (Mapping, list))) if isinstance(schema, list) else True


def schema_violation(value, schema: Mapping, root: Mapping | None = None) -> str | None:
    """The first place where a JSON value breaks a schema, or None.

    Keywords: type, enum, const, required, properties, patternProperties, additionalProperties,
    min/maxProperties, items, prefixItems, min/maxItems, uniqueItems, contains, bounds (exclusive
    ones too), multipleOf, lengths, pattern, anyOf, allOf, oneOf, not, if/then/else, local $ref.
    """
    root = root if root is not None else schema
    if "$ref" in schema:
        at = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            at = at[part]
        return schema_violation(value, at, root)
    if "anyOf" in schema and all(schema_violation(value, s, root) for s in schema["anyOf"]):
        return "anyOf"
    if "oneOf" in schema and sum(schema_violation(value, s, root) is None for s in schema["oneOf"]) != 1:
        return "oneOf"
    for s in schema.get("allOf", ()):
        if bad := schema_violation(value, s, root):
            return bad
    if "not" in schema and schema_violation(value, schema["not"], root) is None:
        return "not"
    if "if" in schema:
        side = "then" if schema_violation(value, schema["if"], root) is None else "else"
        if bad := schema_violation(value, schema.get(side, {}), root):
            return bad
    kinds = schema.get("type")
    if kinds is not None:
        ok = {
            "object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "null": value is None, "boolean": isinstance(value, bool),
            "integer": isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer(), "number": isinstance(value, (int, float)) and not isinstance(value, bool),
        }
        if not any(ok.get(k, False) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            return "type"
    same = lambda a, b: type(a) is type(b) and a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and not {bool} & {type(a), type(b)} and a == b
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        return "enum"
    if "const" in schema and not same(value, schema["const"]):
        return "const"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return "range"
        if value <= schema.get("exclusiveMinimum", value - 1) or value >= schema.get("exclusiveMaximum", value + 1):
            return "range"
        step = schema.get("multipleOf")
        if step and abs(value / step - round(value / step)) > 1e-9:
            return "multipleOf"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return "length"
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        return "pattern"
    if isinstance(value, dict):
        if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
            return "properties"
        for name in schema.get("required", ()):
            if name not in value:
                return f"required: {name}"
        props = schema.get("properties", {})
        shaped = {name: [sub for p, sub in schema.get("patternProperties", {}).items() if re.search(p, name)] for name in value}
        more, extra = schema.get("additionalProperties", True), [name for name in value if name not in props and not shaped[name]]
        if more is False and extra:
            return "additionalProperties"
        for name in extra if isinstance(more, Mapping) else ():
            if bad := schema_violation(value[name], more, root):
                return f"{name}: {bad}"
        for name, subs in shaped.items():
            for sub in subs:
                if bad := schema_violation(value[name], sub, root):
                    return f"{name}: {bad}"
        for name, sub in props.items():
            if name in value and (bad := schema_violation(value[name], sub, root)):
                return f"{name}: {bad}"
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return "items"
        if schema.get("uniqueItems") and any(same(a, b) for i, a in enumerate(value) for b in value[:i]):
            return "uniqueItems"
        if "contains" in schema and all(schema_violation(x, schema["contains"], root) for x in value):
            return "contains"
        first = schema.get("prefixItems", ())
        for k, (item, sub) in enumerate(zip(value, first, strict=False)):
            if bad := schema_violation(item, sub, root):
                return f"{k}: {bad}"
        for k, item in enumerate(value[len(first) :] if isinstance(schema.get("items"), Mapping) else (), len(first)):
            if bad := schema_violation(item, schema["items"], root):
                return f"{k}: {bad}"
    return None


def structured_output(schema: Mapping):
    """Arrow-batched function: JSON text -> (ok, reason); the text itself is kept by the caller."""
    check_schema(schema)

    @F.pandas_udf("ok boolean, reason string")
    def parse(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for t in batch:
                try:
                    value = json.loads(t) if t is not None else None
                except ValueError:
                    out.append((False, "not JSON"))
                    continue
                bad = "not an object" if not isinstance(value, dict) else schema_violation(value, schema)
                out.append((bad is None, bad))
            yield pd.DataFrame(out, columns=["ok", "reason"])

    return parse


def redacted_blocks(blocks: Column) -> Column:
    """Content blocks with inline data replaced by its size (block: type, text, data)."""
    return F.transform(
        blocks,
        lambda b: F.when(b["data"].isNotNull(), F.struct(F.lit("inline_redacted").alias("type"), F.lit(None).cast("string").alias("text"), F.length(b["data"]).cast("long").alias("byte_count"))).otherwise(
            F.struct(b["type"].alias("type"), b["text"].alias("text"), F.lit(None).cast("long").alias("byte_count"))
        ),
    )
