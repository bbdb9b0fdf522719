"""The event log, spans, metrics, budgets, payloads, ids and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import telemetry as T
from ..operators import events as E
from ..session import table
from .registry import query


def _log(spark, d):
    """events as an event log: view and click are node phases, others events of other kinds."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    kind = F.when(F.col("event_type").isin("view", "click", "signup"), "node").otherwise("llm")
    phase = F.when(F.col("event_type") == "view", "started").when(F.col("event_type") == "click", "completed").when(F.col("event_type") == "signup", "checkpoint_saved")
    return e.select("*", kind.alias("kind"), phase.alias("phase"))


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'signup'")
def event_phase_filter(spark, d):
    return E.subscribed(_log(spark, d)).select("event_id", "event_type")


@query("SELECT user_id, count(*) AS n_failures FROM events WHERE event_type = 'error' GROUP BY user_id")
def event_failure_counts(spark, d):
    return E.failure_counts(table(spark, d, "events", "user_id", "event_type"), F.col("event_type") == "error", "user_id")


@query("""SELECT user_id, CAST(min(CASE WHEN event_type = 'view' THEN ts END) AS VARCHAR) AS start, CAST(max(CASE WHEN event_type = 'click' THEN ts END) AS VARCHAR) AS "end" FROM events GROUP BY user_id""")
def span_bounds(spark, d):
    s = E.spans(_log(spark, d), "user_id")
    text = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.(\d*?)0+$", r".$1")
    return s.select("user_id", text("start").alias("start"), text("end").alias("end"))


def _namespaces(spark, d):
    r, n, s = table(spark, d, "region", "r_regionkey", "r_name"), table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), table(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_name")
    nr = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    one = r.select(F.array("r_name").alias("namespace"))
    two = nr.select(F.array("r_name", "n_name").alias("namespace"))
    three = s.join(nr, F.col("s_nationkey") == F.col("n_nationkey")).select(F.array("r_name", "n_name", "s_name").alias("namespace"))
    return one.unionByName(two).unionByName(three).withColumn("invocation_id", F.lit("run"))


@query("""SELECT r_name AS span, NULL AS parent FROM region UNION ALL SELECT r_name || '/' || n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name || '/' || n_name || '/' || s_name, r_name || '/' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def span_parent(spark, d):
    out = E.with_parents(_namespaces(spark, d))
    return out.select(F.array_join("namespace", "/").alias("span"), F.array_join("parent", "/").alias("parent"))


@query("""SELECT r_name || '/' || n_name || '/' || s_name AS span, CASE WHEN n_name LIKE '%1%' THEN 'run/' || r_name || '/' || n_name ELSE 'run' END AS trace
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def span_detached(spark, d):
    """Spans below detached nodes have traces of their own."""
    names = table(spark, d, "nation", "n_name").where("n_name like '%1%'")
    out = E.detached(_namespaces(spark, d).where("size(namespace) = 3"), names)
    return out.select(F.array_join("namespace", "/").alias("span"), "trace")


@query("SELECT l_orderkey AS o_orderkey, l_suppkey AS fan_out_index, CAST(min(l_shipdate) AS VARCHAR) AS start, count(*) AS n_events FROM lineitem GROUP BY 1, 2")
def span_dispatch(spark, d):
    """A grouping span for each instance of a fan-out."""
    e = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_shipdate").toDF("o_orderkey", "fan_out_index", "ts")
    return E.dispatch_spans(e, "o_orderkey", "fan_out_index").select("o_orderkey", "fan_out_index", F.col("start").cast("string").alias("start"), "n_events")


_BOUNDS = ", ".join(repr(0.01 * 2**k) for k in range(14))


@query(f"SELECT event_type, len(list_filter([{_BOUNDS}]::DOUBLE[], lambda b: b < value)) AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def metric_duration_histogram(spark, d):
    e = table(spark, d, "events", "event_type", "value")
    return E.histogram(e, F.col("value"), T.DURATION_BOUNDS, "event_type").select("event_type", F.col("bucket").cast("long").alias("bucket"), "n")


@query("SELECT role, len(list_filter([CAST(pow(4, k) AS BIGINT) for k in range(14)], lambda b: b < length(text))) AS bucket, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS total FROM conversations GROUP BY 1, 2")
def metric_token_histogram(spark, d):
    c = table(spark, d, "conversations", "role", "text")
    h = E.histogram(c, F.char_length("text").cast("long"), T.TOKEN_BOUNDS, "role")
    return h.select("role", F.col("bucket").cast("long").alias("bucket"), "n", "total")


@query("""WITH u AS (SELECT conv_id, sum(CASE WHEN role <> 'assistant' THEN length(text) END) AS p, sum(CASE WHEN role = 'assistant' THEN length(text) END) AS c FROM conversations GROUP BY conv_id)
SELECT conv_id, 'input' AS kind, CAST(p AS BIGINT) AS actual, p > 2000 AS exceeded FROM u WHERE p IS NOT NULL
UNION ALL SELECT conv_id, 'total', CAST(p + c AS BIGINT), p + c > 4000 FROM u WHERE p + c IS NOT NULL""")
def token_budget_eval(spark, d):
    n = F.char_length("text").cast("long")
    own = F.col("role") == "assistant"
    u = table(spark, d, "conversations", "conv_id", "role", "text").groupBy("conv_id").agg(F.sum(F.when(~own, n)).alias("p"), F.sum(F.when(own, n)).alias("c"))
    e = T.token_budget(F.col("p"), F.col("c"), F.lit(None).cast("long"), F.lit(2000), F.lit(4000))
    return u.select("conv_id", F.explode(e).alias("e")).select("conv_id", "e.kind", "e.actual", "e.exceeded")


@query("""SELECT doc_id, strlen(text) AS n_bytes, strlen(text) <= 400 AS whole, CASE WHEN strlen(text) <= 400 THEN sha256(text) ELSE
sha256(decode(array_slice(encode(text), 1, keep)) || '…[truncated, ' || CAST(strlen(text) AS VARCHAR) || ' bytes total]') END AS cut_sha FROM (
SELECT doc_id, text, 400 - strlen('…[truncated, ' || CAST(strlen(text) AS VARCHAR) || ' bytes total]') AS room,
(SELECT max(k) FROM unnest([room, room - 1, room - 2, room - 3]) t(k) WHERE substr(hex(encode(text)), 2 * CAST(k AS INTEGER) + 1, 1) NOT IN ('8', '9', 'A', 'B')) AS keep FROM documents)""")
def payload_truncate_utf8(spark, d):
    """Texts cut to 400 bytes at a character's start, with a marker."""
    t = table(spark, d, "documents", "doc_id", "text")
    return t.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), (F.octet_length("text") <= 400).alias("whole"), F.sha2(T.truncated(F.col("text"), 400), 256).alias("cut_sha"))


@query("SELECT doc_id, substring(sha256(source || '-' || CAST(doc_id AS VARCHAR)), 1, 32) AS trace_id FROM documents")
def trace_id_derivation(spark, d):
    t = table(spark, d, "documents", "doc_id", "source")
    return t.select("doc_id", T.trace_id(F.concat_ws("-", "source", F.col("doc_id").cast("string"))).alias("trace_id"))


@query("SELECT user_id, 'last' AS key, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY 1 UNION ALL SELECT user_id, 'kind', arg_min(event_type, event_id) FROM events GROUP BY 1")
def metadata_merge(spark, d):
    """The first event's metadata with additions of the last: the later value of a key wins."""
    g = table(spark, d, "events", "user_id", "event_id", "event_type").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("kind"), F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    old = F.create_map(F.lit("kind"), F.col("kind"), F.lit("last"), F.col("a").cast("string"))
    new = F.create_map(F.lit("last"), F.col("b").cast("string"))
    return g.select("user_id", F.explode(T.merged_metadata(old, new)).alias("key", "value"))


@query("""SELECT key, key LIKE 'gen_ai.%' OR key LIKE 'flowloom.%' OR key IN ('step', 'namespace') AS reserved, count(*) AS n FROM (
SELECT CASE event_id % 4 WHEN 0 THEN 'gen_ai.' || event_type WHEN 1 THEN 'flowloom.x' WHEN 2 THEN 'step' ELSE event_type END AS key FROM events) GROUP BY ALL""")
def metadata_key_check(spark, d):
    m = F.col("event_id") % 4
    key = F.when(m == 0, F.concat(F.lit("gen_ai."), "event_type")).when(m == 1, "flowloom.x").when(m == 2, "step").otherwise(F.col("event_type"))
    return table(spark, d, "events", "event_id", "event_type").select(key.alias("key")).groupBy("key", T.reserved_key(F.col("key")).alias("reserved")).agg(F.count("*").alias("n"))


@query("""SELECT r_name || '/' || n_name || '/' || s_name AS span, CASE WHEN s_suppkey % 2 = 0 THEN 'even' END AS own, n_nationkey = 3 AS unused FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def metadata_augmentation(spark, d):
    """Additions reach their own span and its ancestors, never siblings."""
    spans = _namespaces(spark, d)
    s = table(spark, d, "supplier", "s_suppkey", "s_name").where("s_suppkey % 2 = 0")
    adds = spans.where("size(namespace) = 3").join(s, F.element_at("namespace", 3) == F.col("s_name")).select("invocation_id", "namespace", F.lit("mark").alias("key"), F.lit("even").alias("value"), F.col("s_suppkey").alias("seq"))
    out = E.augmented(spans, adds).where("size(namespace) = 3")
    nations = table(spark, d, "nation", "n_nationkey", "n_name")
    return out.join(nations, F.element_at("namespace", 2) == F.col("n_name")).select(F.array_join("namespace", "/").alias("span"), F.element_at("metadata", "mark").alias("own"), (F.col("n_nationkey") == 3).alias("unused"))


@query("SELECT count(*) AS n_total, count(CASE WHEN event_id % 3 <> 0 THEN 1 END) AS n_delivered, count(*) - count(CASE WHEN event_id % 3 <> 0 THEN 1 END) AS n_outstanding FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events)")
def drain_snapshot(spark, d):
    e = table(spark, d, "events", "event_id").withColumn("delivered", F.col("event_id") % 3 != 0)
    half = e.agg(F.floor(F.max("event_id") / 2)).first()[0]  # the number that the log had come to
    return E.delivered(e, "event_id", half)


@query("""SELECT event_id, '{"kind":"' || event_type || '","user":' || CAST(user_id AS VARCHAR) || '}' AS payload FROM events""")
def payload_canonical_json(spark, d):
    return table(spark, d, "events", "event_id", "event_type", "user_id").select("event_id", T.canonical_json({"user": F.col("user_id"), "kind": F.col("event_type")}).alias("payload"))


@query("SELECT CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_delivery(spark, d):
    """The event log as a stream, delivered in micro-batches to a table that is then counted."""
    import uuid

    from ..sources.scratch import Scratch
    from ..streaming.delivery import deliver, event_stream

    root = Scratch(spark, "stream").root
    source = table(spark, d, "events", "event_id", "ts", "event_type")
    stream = event_stream(spark, d, table(spark, d, "events").schema, "events.parquet").select("event_id", "ts", "event_type")

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    q = deliver(stream, {"table": sink}, f"{root}/checkpoint-{uuid.uuid4().hex}")
    q.awaitTermination()
    got = spark.read.schema(source.schema).parquet(f"{root}/out")
    return got.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))
