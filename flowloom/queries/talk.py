"""Completion calls on whole conversations with tools and usage, and schemas as expressions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..errors import ProviderError
from ..functions.json_schema import schema_check
from ..functions.templates import Dispatcher
from ..operators import chat
from ..session import table
from .registry import query


def stub_transport(body, attempt):
    """Asks for the tool once, then says how many messages it was sent and what the tool said; every 7th length is busy first."""
    said = json.loads(body)["messages"]
    if len(said) % 7 == 0 and not attempt:
        raise ProviderError("provider_rate_limit", "busy")
    tools = [m for m in said if m["role"] == "tool"]
    if tools:
        message, reason = {"content": f"n={len(said)};chars={tools[-1]['content']}"}, "stop"
    else:
        call = {"id": f"call-{len(said)}", "type": "function", "function": {"name": "measure", "arguments": json.dumps({"messages": len(said)})}}
        message, reason = {"content": None, "tool_calls": [call]}, "tool_calls"
    usage = {"prompt_tokens": len(said), "completion_tokens": len(message["content"] or ""), "total_tokens": len(said) + len(message["content"] or "")}
    return json.dumps({"id": "r", "model": "stub", "choices": [{"message": message, "finish_reason": reason}], "usage": usage})


def _talked(spark, d):
    rows = table(spark, d, "conversations", "conv_id", "turn", "role", "text").withColumnRenamed("text", "content")
    more = rows.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select("conv_id", "turn", F.lit("user").alias("role"), F.lit("Go on.").alias("content"))
    sizes = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.sum(F.char_length("content")).alias("chars"))

    def measure(asked):
        return asked.join(sizes, asked["conv_id"] == sizes["_c"]).select("conv_id", "tool_call_id", F.col("chars").cast("string").alias("content"))

    tools = [{"name": "measure", "description": "characters of a conversation", "parameters": {"type": "object"}}]
    return chat.converse(rows.unionByName(more), stub_transport, measure, {"model": "stub"}, tools, attempts=2, base=0.0)


_TALK = """WITH c AS (SELECT conv_id, arg_min(role, turn) AS first_role, count(*) AS n, sum(length(text)) AS chars, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) - CASE WHEN arg_min(role, turn) = 'system' THEN 1 ELSE 0 END AS late,
  count_if(coalesce(text, '') = '') AS blank FROM conversations GROUP BY conv_id),
v AS (SELECT *, CASE WHEN first_role NOT IN ('system', 'user') THEN 'first_role' WHEN late > 0 THEN 'system_late' WHEN blank > 0 THEN 'empty' END AS bad,
  'n=' || CAST(n + 3 AS VARCHAR) || ';chars=' || CAST(chars AS VARCHAR) AS said FROM c)
"""


@query(_TALK + """SELECT conv_id, CASE WHEN bad IS NULL THEN CAST(2 AS BIGINT) ELSE 1 END AS calls, CASE WHEN bad IS NULL THEN said END AS said,
CAST(CASE WHEN bad IS NULL THEN 2 * n + 4 END AS BIGINT) AS prompt_tokens, CAST(CASE WHEN bad IS NULL THEN length(said) END AS BIGINT) AS completion_tokens,
CAST(CASE WHEN bad IS NULL THEN 2 + CASE WHEN (n + 1) % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN (n + 3) % 7 = 0 THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS attempts FROM v""")
def converse_with_tool(spark, d):
    """A call, a tool's answer from the table and a second call for every valid conversation, with usage and attempts."""
    _, calls = _talked(spark, d)
    return calls.groupBy(F.col("id").alias("conv_id")).agg(
        F.count("*").alias("calls"), F.max_by("content", "round").alias("said"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("attempts").alias("attempts")
    )


@query(_TALK + """SELECT conv_id, r AS round, CASE WHEN bad IS NULL THEN 'llm_completion' ELSE 'llm_failed' END AS kind, CASE WHEN bad IS NOT NULL THEN 'provider_invalid_request' END AS category,
CASE WHEN bad IS NULL THEN CASE r WHEN 0 THEN 'tool_calls' ELSE 'stop' END END AS reason FROM v, (SELECT unnest([0, 1]) AS r) WHERE r = 0 OR bad IS NULL""")
def converse_events(spark, d):
    """One event a call: completed with its reason, or failed with its category."""
    _, calls = _talked(spark, d)
    e = chat.completion_events(calls.withColumns({"at": F.lit(None).cast("timestamp"), "id": F.concat_ws("/", "id", "round")}), "at")
    who = F.split("invocation_id", "/")
    return e.select(who[0].cast("bigint").alias("conv_id"), who[1].cast("int").alias("round"), "kind", "category", F.get_json_object("attributes", "$.finish_reason").alias("reason"))


@query(_TALK + """SELECT v.conv_id, turn, role, text AS content FROM v JOIN conversations c ON c.conv_id = v.conv_id
UNION ALL SELECT conv_id, m + 1, 'user', 'Go on.' FROM v JOIN (SELECT conv_id AS k, max(turn) AS m FROM conversations GROUP BY 1) ON k = conv_id
UNION ALL SELECT conv_id, m + 2, 'assistant', '' FROM v JOIN (SELECT conv_id AS k, max(turn) AS m FROM conversations GROUP BY 1) ON k = conv_id WHERE bad IS NULL
UNION ALL SELECT conv_id, m + 3, 'tool', CAST(chars AS VARCHAR) FROM v JOIN (SELECT conv_id AS k, max(turn) AS m FROM conversations GROUP BY 1) ON k = conv_id WHERE bad IS NULL
UNION ALL SELECT conv_id, m + 4, 'assistant', said FROM v JOIN (SELECT conv_id AS k, max(turn) AS m FROM conversations GROUP BY 1) ON k = conv_id WHERE bad IS NULL""")
def converse_messages(spark, d):
    """All message rows after the rounds: what was there, the calls for tools, their answers, the last word."""
    messages, _ = _talked(spark, d)
    return messages.select("conv_id", "turn", "role", "content")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n, (SELECT max(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS q FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status: not in enum' WHEN o_totalprice > 300000 THEN 'price: maximum' WHEN n > 6 THEN 'quantities: maxItems'
  WHEN q > 49 THEN 'quantities: quantity' WHEN o_orderkey % 10 = 0 THEN 'note: oneOf' END AS broken FROM o""")
def schema_native_rules(spark, d):
    """Orders as JSON against a schema of nested rules; the first that breaks, without Python."""
    schema = {
        "type": "object", "required": ["status", "price", "quantities"], "additionalProperties": False,
        "properties": {
            "status": {"type": "string", "enum": ["O", "F"]}, "price": {"type": "number", "maximum": 300_000}, "quantities": {"type": "array", "maxItems": 6, "items": {"$ref": "#/$defs/quantity"}},
            "note": {"oneOf": [{"type": "string", "maxLength": 3}, {"type": "string", "pattern": "^long"}]},
        },
        "$defs": {"quantity": {"type": "number", "minimum": 1, "maximum": 49}},
    }
    lines = table(spark, d, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("double")).alias("quantities"))
    orders = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    note = F.when(F.col("o_orderkey") % 10 == 0, "none").when(F.col("o_orderkey") % 3 == 0, "long story").otherwise("ok")
    text = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("price"), F.coalesce("quantities", F.array().cast("array<double>")).alias("quantities"), note.alias("note")))
    broken = schema_check(schema)(text)
    return orders.select("o_orderkey", F.when(broken.rlike("^quantities: [0-9]"), "quantities: quantity").otherwise(broken).alias("broken"))


# ------------------------------------------------------------------ templates by row


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_totalprice AS p, o_orderkey % 6 AS k, (SELECT list(l_linenumber ORDER BY l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN CASE WHEN p > 150000 THEN 'big' ELSE 'small' END || ' ' || s WHEN 1 THEN coalesce(array_to_string(list_transform(lines, lambda x, i: CAST(i AS VARCHAR) || ':' || CAST(x AS VARCHAR)), ','), 'none')
  WHEN 2 THEN 'Order ' || CAST(o_orderkey AS VARCHAR) || ': ' || s WHEN 5 THEN 'yes-no-' || CASE WHEN len(lines) > 0 THEN 'some' ELSE 'empty' END END AS text,
CASE k WHEN 3 THEN 'nothing is not defined' WHEN 4 THEN 'other is not defined' END AS error FROM o""")
def prompt_template_by_row(spark, d):
    """Each order has a template of its own: with blocks, with plain names and a key, or with names that aren't there."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"))
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    kinds = {
        0: F.lit("{% if price > 150000 %}big{% else %}small{% endif %} {{ status }}"), 1: F.lit("{% for x in lines %}{{ loop.index }}:{{ x }}{% if not loop.last %},{% endif %}{% else %}none{% endfor %}"),
        2: F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(": {{ status }}")), 3: F.lit("{{ nothing|upper }}"), 4: F.lit("{{ other }}"),
        5: F.lit("{% if zero_text %}yes{% endif %}-{% if zero %}yes{% else %}no{% endif %}-{% if lines %}some{% else %}empty{% endif %}"),
    }
    template = F
    for k, t in kinds.items():
        template = template.when(F.col("o_orderkey") % 6 == k, t)
    o = o.withColumn("template", template)
    scope = {"price": F.col("o_totalprice"), "status": F.col("o_orderstatus"), "lines": F.coalesce("lines", F.array().cast("array<int>")), "zero_text": F.lit("0"), "zero": F.lit(0).cast("decimal(9,2)")}
    by = Dispatcher.of(o, F.col("template"), scope)
    return o.select("o_orderkey", by.text(F.col("template")).alias("text"), by.error(F.col("template")).alias("error"))
