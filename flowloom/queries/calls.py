"""Provider calls, resumed fan-outs and single-event spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import ProviderError
from ..functions import prompts as P
from ..functions import reducers as R
from ..functions import retrieval as V
from ..functions import telemetry as T
from ..operators import checkpoints, completion, fan_out
from ..operators import events as E
from ..session import table
from .graphs import LINE_ORDER
from .registry import query


def stub_client(messages, config, attempt):
    """A deterministic provider: busy for id % 4 attempts, refuses ids that 25 divides, and
    answers outside its schema at first for ids that 7 divides."""
    i = messages[0]["id"]
    if i % 25 == 0:
        raise ProviderError("provider_invalid_request", "refused")
    if i % 7 == 0 and len(messages) == 1:
        raise ProviderError("structured_output_invalid", "no object", "raw text")
    if i % 7 and attempt < i % 4:
        raise ProviderError("provider_rate_limit", "busy")
    return {"text": f"{len(messages)} messages"}


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 25 = 0 OR (doc_id % 7 <> 0 AND doc_id % 4 = 3) THEN NULL WHEN doc_id % 7 = 0 THEN '3 messages' ELSE '1 messages' END AS text,
CASE WHEN doc_id % 25 = 0 THEN 'provider_invalid_request' WHEN doc_id % 7 <> 0 AND doc_id % 4 = 3 THEN 'provider_rate_limit' END AS category,
CAST(a AS BIGINT) AS attempts, [0.0, 0.3, 0.6][a]::DOUBLE AS temperature,
CASE WHEN doc_id % 25 = 0 THEN '' WHEN doc_id % 7 = 0 THEN 'reask' ELSE array_to_string(list_transform(range(a - 1), lambda x: 'transient'), ',') END AS reasons
FROM (SELECT doc_id, CASE WHEN doc_id % 25 = 0 THEN 1 WHEN doc_id % 7 = 0 THEN 2 ELSE least(doc_id % 4 + 1, 3) END AS a FROM documents)""")
def complete_with_retry(spark, d):
    """Calls with up to three attempts, escalating temperatures and one informed repetition."""
    retry = completion.CallRetry(3, ({"temperature": 0.3}, {"temperature": 0.6}), lambda raw, reason: f"not valid: {reason}")
    return completion.completed(table(spark, d, "documents", "doc_id", "source"), stub_client, "doc_id", "source", {"temperature": 0.0}, retry)


@query("""SELECT conv_id, turn, role, text AS content, sha256('{"content":' || to_json(text) || ',"role":"' || role || '"}') AS wire_sha FROM conversations""")
def message_wire_round_trip(spark, d):
    """Messages to the wire's JSON and back."""
    m = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    w = m.withColumn("wire", completion.wire_message(F.col("role"), F.col("text")))
    back = completion.from_wire(F.col("wire"))
    return w.select("conv_id", "turn", back["role"].alias("role"), back["content"].alias("content"), F.sha2("wire", 256).alias("wire_sha"))


_LINES = ", ".join(LINE_ORDER)


@query(f"""SELECT o_orderkey, coalesce(string_agg(CASE WHEN n % 2 = 0 THEN 'saved ' ELSE 'ran ' END || CAST(l_partkey AS VARCHAR), ',' ORDER BY n), '') AS results, false AS changed FROM orders
LEFT JOIN (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) - 1 AS n FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1""")
def fanout_resume(spark, d):
    """Even instances were completed before: they roll forward, the odd ones run."""
    lines = table(spark, d, "lineitem", "l_orderkey", *LINE_ORDER)
    items = lines.groupBy("l_orderkey").agg(R.fold_append(F.col("l_partkey"), *LINE_ORDER).alias("items"))
    rows = table(spark, d, "orders", "o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "items")
    inst = fan_out.exploded(rows, "items")
    saved = inst.where("fan_out_index % 2 = 0").select("o_orderkey", "fan_out_index", F.concat(F.lit("saved "), F.col("item").cast("string")).alias("out"))
    child = lambda df: df.withColumn("out", F.concat(F.lit("ran "), F.col("item").cast("string")))
    return fan_out.resumed(rows, "o_orderkey", "items", saved, child, {"results": "out"}).select("o_orderkey", F.array_join("results", ",").alias("results"), "changed")


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'tool' WHEN 'error' THEN 'failure_isolated' ELSE 'checkpoint' END AS kind,
CAST(CASE WHEN event_type = 'purchase' THEN event_id % 100 ELSE 0 END AS BIGINT) AS length_ms FROM events WHERE event_type IN ('purchase', 'error', 'signup')""")
def span_markers(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "tool").when(F.col("event_type") == "error", "failure_isolated").when(F.col("event_type") == "signup", "checkpoint").otherwise("node")
    e = table(spark, d, "events", "event_id", "ts", "event_type").select("event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), (F.col("event_id") % 100).alias("latency_ms"))
    m = E.markers(e)
    return m.select("event_id", "kind", F.round((F.unix_micros("end") - F.unix_micros("start")) / 1000).cast("long").alias("length_ms"))


@query("""SELECT n_name AS id, count(s_suppkey) AS n_children FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT s_name, 0 FROM supplier""")
def observation_children(spark, d):
    n, s = table(spark, d, "nation", "n_nationkey", "n_name"), table(spark, d, "supplier", "s_name", "s_nationkey")
    obs = n.select(F.col("n_name").alias("id"), F.lit(None).cast("string").alias("parent")).unionByName(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("id"), F.col("n_name").alias("parent")))
    return E.children(obs).select("id", "n_children")


@query("""SELECT conv_id, count(*) AS n_calls, CAST(sum(CASE WHEN role <> 'assistant' THEN length(text) END) AS VARCHAR) AS prompt_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) END) AS VARCHAR) AS completion_tokens FROM conversations GROUP BY 1""")
def usage_accumulate(spark, d):
    n, own = F.char_length("text").cast("long"), F.col("role") == "assistant"
    c = table(spark, d, "conversations", "conv_id", "role", "text").select("conv_id", F.when(~own, n).alias("prompt_tokens"), F.when(own, n).alias("completion_tokens"))
    return E.usage(c, "conv_id").select("conv_id", "n_calls", *(F.col(c).cast("string").alias(c) for c in ("prompt_tokens", "completion_tokens")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id WHEN doc_id % 3 = 1 THEN 60 END::DOUBLE AS ttl FROM documents")
def prompt_ttl(spark, d):
    """A call's time to live, else the default; negative ones are refused."""
    own = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("double")).when(F.col("doc_id") % 3 == 2, F.lit(-1.0))
    return table(spark, d, "documents", "doc_id").select("doc_id", P.effective_ttl(own, 60.0).alias("ttl"))


@query("SELECT page_id, regexp_full_match(url, '[A-Za-z0-9._~-]+') AS valid, CASE WHEN page_id % 2 = 0 THEN 'retrieval.query' END AS task FROM pages")
def invocation_id_check(spark, d):
    task, _ = V.wire_type(F.when(F.col("page_id") % 2 == 0, "query"), V.JINA_TASKS, None)
    return table(spark, d, "pages", "page_id", "url").select("page_id", T.valid_invocation_id(F.col("url")).alias("valid"), task.alias("task"))


@query("SELECT CAST(user_id AS VARCHAR) AS invocation_id, max(event_id) AS seq FROM events GROUP BY user_id HAVING user_id % 3 <> 0")
def checkpoint_delete(spark, d):
    """Deleted invocations have a tombstone as their last save."""
    e = table(spark, d, "events", "event_id", "user_id").select(F.col("user_id").cast("string").alias("invocation_id"), F.col("event_id").alias("seq"), "user_id")
    gone = e.where("user_id % 3 = 0").select("invocation_id").distinct().select("invocation_id", F.lit(2**62).alias("seq"))
    return checkpoints.latest(e.select("invocation_id", "seq").unionByName(gone))
