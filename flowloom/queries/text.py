"""Conversations, structured output and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.json_schema import schema_check
from ..functions import prompts as P
from ..session import table
from .registry import query

_LIST_SQL = """SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, count(*) AS n_messages,
CAST(sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) - CASE WHEN arg_min(role, turn) = 'system' THEN 1 ELSE 0 END AS BIGINT) AS late_systems FROM conversations GROUP BY conv_id"""


@query(_LIST_SQL)
def message_list_validation(spark, d):
    return M.list_errors(table(spark, d, "conversations", "conv_id", "turn", "role")).drop("error")


@query(f"""SELECT conv_id, CASE WHEN first_role NOT IN ('system', 'user') THEN 'first_role' WHEN late_systems > 0 THEN 'system_late' WHEN last_role NOT IN ('user', 'tool') THEN 'last_role' END AS error FROM ({_LIST_SQL})""")
def message_first_error(spark, d):
    return M.list_errors(table(spark, d, "conversations", "conv_id", "turn", "role")).select("conv_id", "error")


@query("""SELECT conv_id, turn, CASE WHEN role IN ('system', 'user') AND text = '' THEN 'content_empty' WHEN role = 'assistant' AND text = '' THEN 'assistant_empty' END AS error FROM conversations""")
def message_rules(spark, d):
    return table(spark, d, "conversations", "conv_id", "turn", "role", "text").select("conv_id", "turn", M.message_error(F.col("role"), F.col("text")).alias("error"))


@query("""WITH m AS (SELECT user_id, event_id, event_type, CAST(value AS BIGINT) % 7 AS c FROM events),
calls AS (SELECT user_id, c, min(event_id) AS since FROM m WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT m.user_id, m.event_id, CAST(m.c AS VARCHAR) AS tool_call_id FROM m LEFT JOIN calls USING (user_id, c) WHERE event_type = 'click' AND (since IS NULL OR since >= m.event_id)""")
def message_tool_references(spark, d):
    """Tool messages (clicks) whose id no earlier assistant message (purchase) declares."""
    e = table(spark, d, "events", "user_id", "event_id", "event_type", "value").where("event_type in ('purchase', 'click')")
    call = F.bround("value", 0).cast("long") % 7
    m = e.select(
        "user_id", "event_id", F.when(F.col("event_type") == "purchase", "assistant").otherwise("tool").alias("role"), F.array(call.cast("string")).alias("tool_call_ids"), call.cast("string").alias("tool_call_id")
    )
    return M.unmatched_tool_messages(m, "user_id", "event_id").select("user_id", "event_id", "tool_call_id")


@query("""SELECT event_id, json_valid(props) AND json_type(props) = 'OBJECT' AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS ok FROM events""")
def structured_output_parse(spark, d):
    """JSON objects with a whole number k."""
    broken = schema_check({"type": "object", "properties": {"k": {"type": "integer"}}, "required": ["k"]})
    return table(spark, d, "events", "event_id", "props").select("event_id", broken(F.col("props")).isNull().alias("ok"))


@query("""SELECT doc_id, coalesce(CASE WHEN doc_id % 10 = 0 THEN 'pinned' END, CASE lang WHEN 'en' THEN 'stable' WHEN 'de' THEN 'beta' END, 'latest') AS label FROM documents""")
def prompt_label_resolution(spark, d):
    t = table(spark, d, "documents", "doc_id", "lang")
    return t.select("doc_id", P.resolved_label(F.when(F.col("doc_id") % 10 == 0, "pinned"), F.col("lang"), {"en": "stable", "de": "beta", "default": "latest"}).alias("label"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ok' WHEN doc_id % 5 = 0 THEN 'not_found' WHEN doc_id % 7 = 0 THEN 'ok' ELSE 'prompt_store_unavailable' END AS status,
CAST(CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 7 = 0 THEN 2 END AS VARCHAR) AS backend_ord FROM documents""")
def prompt_backend_fallback(spark, d):
    """Three sources in order: found, or not found, decides; unavailable goes on."""
    t = table(spark, d, "documents", "doc_id")
    status = F.array(
        F.when(F.col("doc_id") % 3 == 0, "ok").otherwise("unavailable"), F.when(F.col("doc_id") % 5 == 0, "not_found").otherwise("unavailable"), F.when(F.col("doc_id") % 7 == 0, "ok").otherwise("unavailable")
    )
    c = t.select("doc_id", F.posexplode(status).alias("backend_ord", "status"))
    return P.fetched(c, "doc_id").withColumn("backend_ord", F.col("backend_ord").cast("string"))


@query("SELECT doc_id, 'Document ' || CAST(doc_id AS VARCHAR) || ' in ' || lang || ' from ' || source || '; {{ missing }}' AS text, 'missing' AS undefined FROM documents")
def prompt_render(spark, d):
    t = table(spark, d, "documents", "doc_id", "lang", "source")
    template = F.lit("Document {{ id }} in {{lang}} from {{ source }}; {{ missing }}")
    v = F.create_map(F.lit("id"), F.col("doc_id").cast("string"), F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    return t.select("doc_id", P.rendered(template, v).alias("text"), F.array_join(P.undefined(template, v), ",").alias("undefined"))


@query("SELECT doc_id, 'system:You answer in ' || lang || '|user:first|assistant:second|user:' || source AS chat FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 2 <> 0")
def prompt_chat_render(spark, d):
    """Segments in order; a placeholder brings messages, a missing one is an error (null)."""
    seg = lambda role, template, placeholder: F.struct(F.lit(role).cast("string").alias("role"), F.lit(template).cast("string").alias("template"), F.lit(placeholder).cast("string").alias("placeholder"))
    segments = F.array(seg("system", "You answer in {{ lang }}", None), seg(None, None, "history"), seg("user", "{{ source }}", None))
    msg = lambda r, c: F.struct(F.lit(r).alias("role"), F.lit(c).alias("content"))
    name = F.when(F.col("doc_id") % 2 == 0, "history").otherwise("other")
    injected = F.create_map(name, F.array(msg("user", "first"), msg("assistant", "second")))
    v = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    out = P.chat(segments, v, injected)
    return table(spark, d, "documents", "doc_id", "lang", "source").select("doc_id", F.array_join(F.transform(out, lambda m: F.concat_ws(":", m["role"], m["content"])), "|").alias("chat"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS template_hash, substring(sha256(text), 1, 16) AS version FROM documents")
def prompt_template_hash(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", P.template_hash(F.col("text")).alias("template_hash"), P.version(F.col("text")).alias("version"))


@query("""SELECT doc_id, 'sha256:' || sha256('[{"content":"' || source || '","role":"' || lang || '"}]') AS rendered_hash FROM documents""")
def prompt_rendered_hash(spark, d):
    return table(spark, d, "documents", "doc_id", "lang", "source").select("doc_id", P.rendered_hash(F.col("lang"), F.col("source")).alias("rendered_hash"))


@query("SELECT conv_id, count(*) AS n_members, count(*) >= 2 AS valid FROM conversations GROUP BY conv_id")
def prompt_group_arity(spark, d):
    return P.groups(table(spark, d, "conversations", "conv_id"), "conv_id")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS temperature, CAST(n_chars AS BIGINT) AS input_max_tokens FROM documents")
def prompt_sidecar_config(spark, d):
    """Top-level sampling keys win over "extras"; the token budget is an object of its own."""
    t = table(spark, d, "documents", "doc_id", "n_chars")
    top = F.concat(F.lit('{"temperature":0.5,"extras":{"temperature":0.25},"token_budget":{"input_max_tokens":'), F.col("n_chars").cast("string"), F.lit("}}"))
    low = F.concat(F.lit('{"extras":{"temperature":0.25},"token_budget":{"input_max_tokens":'), F.col("n_chars").cast("string"), F.lit("}}"))
    s = P.sidecar(F.when(F.col("doc_id") % 2 == 0, top).otherwise(low))
    return t.select("doc_id", s["temperature"].alias("temperature"), s["input_max_tokens"].alias("input_max_tokens"))
