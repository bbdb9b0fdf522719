"""Middleware, instance rules, saves of every node, typed events, providers, tools and templates."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import functions as F

from ..errors import FlowError, ProviderError
from ..functions import messages as M
from ..functions import prompts as P
from ..functions import reducers as R
from ..functions import telemetry as T
from ..functions.templates import rendered_template
from ..operators import checkpoints, completion, providers
from ..operators import events as E
from ..operators import typed_events as Y
from ..plans.graph import END, Explicit, Fail, FanOut, GraphBuilder, RoundTripWarning
from ..plans.program import retry, run, short_circuit
from ..plans.schema import Field, StateSchema
from ..session import table
from ..sources.prompts import templates
from ..sources.scratch import Scratch
from .graphs import order_items
from .registry import query

# ------------------------------------------------------------------ graphs


def _single(schema: StateSchema, fn, middleware=(), whole=()):
    b = GraphBuilder(schema).add_node("n", fn, middleware).add_edge("n", END).set_entry("n")
    for m in whole:
        b.add_middleware(m)
    return b.compile()


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'graph(node(' || o_orderpriority || '))' END AS note FROM orders")
def middleware_chain(spark, d):
    """Middleware of the graph lies around that of the node; a short circuit skips the node."""
    schema = StateSchema({"status": Field("string"), "note": Field("string")})
    around = lambda name: lambda fn: lambda s: {"note": F.concat(F.lit(f"{name}("), fn(s)["note"], F.lit(")"))}
    g = _single(schema, lambda s: {"note": s["note"]}, (around("node"),), (short_circuit(lambda s: s["status"] == "F", {"note": "closed"}), around("graph")))
    rows = schema.initial_state(table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority"), status="o_orderstatus", note="o_orderpriority")
    return run(g, rows).select("o_orderkey", "note")


@query("SELECT o_custkey, max(o_totalprice) AS most FROM orders GROUP BY o_custkey")
def custom_reducer(spark, d):
    """A merge rule of one's own, folded over many updates of a row."""
    largest = R.Reducer("largest", lambda p, u: F.greatest(p, u), round_trip_idempotent=True)
    schema = StateSchema({"most": Field("double", None, largest), "prices": Field("array<double>")})
    child = StateSchema({"most": Field("double", None, largest)})
    orders = table(spark, d, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    g = _single(schema, lambda s: {"most": F.get(s["prices"], F.lit(0))})
    assert child.reducer("most").name == "largest"
    return run(g, schema.initial_state(orders, most="lo", prices=F.array("hi", "lo", "hi"))).select("o_custkey", "most")


class _Doubling:
    """A projection of one's own: only the balance goes in, only its double comes out."""

    def inward(self, parent, child):
        return {"x": "balance"}

    def outward(self, parent, child):
        return {"doubled": "y"}

    def check(self, parent, child):
        assert "x" in child.fields


@query("SELECT s_suppkey, s_acctbal * 2 AS doubled FROM supplier")
def projection_custom(spark, d):
    child = _single(StateSchema({"x": Field("double"), "y": Field("double")}), lambda s: {"y": s["x"] * 2})
    parent = StateSchema({"balance": Field("double"), "doubled": Field("double")})
    g = GraphBuilder(parent).add_subgraph("sub", child, _Doubling()).add_edge("sub", END).set_entry("sub").compile()
    return run(g, parent.initial_state(table(spark, d, "supplier", "s_suppkey", "s_acctbal"), balance="s_acctbal")).select("s_suppkey", "doubled")


@query("""SELECT * FROM (VALUES ('no_entry', 'no_declared_entry'), ('unreachable', 'unreachable_node'), ('dangling', 'dangling_edge'), ('two_edges', 'multiple_outgoing_edges'),
('two_rules', 'conflicting_reducers'), ('unknown_field', 'mapping_references_undeclared_field'), ('no_list', 'fan_out_field_not_list'), ('both_modes', 'fan_out_count_mode_ambiguous'),
('degraded', 'fan_out_degraded_update_missing_collect_field'), ('no_branches', 'parallel_branches_no_branches'), ('round_trip', 'warning'), ('sound', 'none')) t("case", category)""")
def compile_checks(spark, d):
    """Graphs that are refused, one that is warned of and a sound one; checked on the driver."""
    schema = StateSchema({"a": Field("int"), "xs": Field("array<int>", [], R.APPEND)})
    child = _single(StateSchema({"item": Field("int"), "out": Field("int")}), lambda s: {"out": s["item"]})
    echo = _single(StateSchema({"xs": Field("array<int>", [], R.APPEND)}), lambda s: {})
    node = lambda s: {"a": F.lit(1)}
    new = lambda: GraphBuilder(schema)
    fan = lambda **kw: FanOut(child, "xs", "out", **{"items_field": "xs", "item_field": "item", **kw})
    cases = {
        "no_entry": lambda: new().add_node("n", node).compile(),
        "unreachable": lambda: new().add_node("n", node).add_node("m", node).add_edge("n", END).set_entry("n").compile(),
        "dangling": lambda: new().add_node("n", node).add_edge("n", "x").set_entry("n").compile(),
        "two_edges": lambda: new().add_node("n", node).add_edge("n", END).add_edge("n", END).set_entry("n").compile(),
        "two_rules": lambda: _single(StateSchema({"a": Field("int", None, (R.APPEND, R.MERGE))}), node),
        "unknown_field": lambda: new().add_subgraph("s", child, Explicit({"nope": "a"})).add_edge("s", END).set_entry("s").compile(),
        "no_list": lambda: new().add_fan_out("f", FanOut(child, "a", "out", items_field="xs")),
        "both_modes": lambda: new().add_fan_out("f", fan(count=2)),
        "degraded": lambda: new().add_fan_out("f", fan(degraded={"item": 0})),
        "no_branches": lambda: new().add_branches("b", {}),
        "round_trip": lambda: new().add_subgraph("s", echo, Explicit({"xs": "xs"}, {"xs": "xs"})).add_edge("s", END).set_entry("s").compile(),
        "sound": lambda: _single(schema, node),
    }

    def outcome(make) -> str:
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            try:
                make()
            except FlowError as e:
                return e.category
            return "warning" if any(issubclass(w.category, RoundTripWarning) for w in seen) else "none"

    return spark.createDataFrame([(k, outcome(make)) for k, make in cases.items()], "case string, category string")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'fan_out_invalid_count' END AS category, CASE WHEN p_size % 3 = 0 THEN 0 ELSE CAST(p_size % 3 AS BIGINT) END AS n FROM part")
def fanout_negative_count(spark, d):
    """A count below zero, or none, fails the row."""
    leaf = _single(StateSchema({"out": Field("int")}), lambda s: {"out": 1})
    schema = StateSchema({"k": Field("int"), "outs": Field("array<int>", [])})
    spec = FanOut(leaf, "outs", "out", count=lambda s: F.when(s["k"] % 3 == 0, F.when(s["k"] % 2 == 0, -1)).otherwise(s["k"] % 3), on_empty="noop")
    g = GraphBuilder(schema).add_fan_out("f", spec).add_edge("f", END).set_entry("f").compile()
    out = run(g, schema.initial_state(table(spark, d, "part", "p_partkey", "p_size"), k="p_size"))
    return out.select("p_partkey", F.col("_error.fan_out_category").alias("category"), F.size("outs").cast("long").alias("n"))


@query("""SELECT o_orderkey, count(l_orderkey) AS n, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS n_set FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def fanout_missing_collect(spark, d):
    """Instances that never write the collected field contribute its default, in their place."""
    item = "struct<price:decimal(18,2),discount:decimal(18,2)>"
    child = StateSchema({"item": Field(item), "big": Field("boolean")})
    skip = short_circuit(lambda s: s["item"]["discount"] <= 0.05, {})
    leaf = GraphBuilder(child).add_node("n", lambda s: {"big": True}, (skip,)).add_edge("n", END).set_entry("n").compile()
    schema = StateSchema({"items": Field(f"array<{item}>"), "bigs": Field("array<boolean>", [])})
    spec = FanOut(leaf, "bigs", "big", items_field="items", item_field="item", on_empty="noop")
    g = GraphBuilder(schema).add_fan_out("f", spec).add_edge("f", END).set_entry("f").compile()
    out = run(g, schema.initial_state(order_items(spark, d)))
    return out.select("o_orderkey", F.size("bigs").cast("long").alias("n"), F.size(F.filter("bigs", lambda x: x.isNotNull())).cast("long").alias("n_set"))


@query("""SELECT o_orderkey, count(l_orderkey) AS n, coalesce(sum(CASE WHEN l_discount > 0.08 THEN 2 ELSE 0 END), 0)::VARCHAR AS attempts, count(CASE WHEN l_discount > 0.09 THEN 1 END) AS n_failed
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def fanout_instance_middleware(spark, d):
    """Every instance has its own retries: dear ones need a third attempt, the dearest fail."""
    item = "struct<price:decimal(18,2),discount:decimal(18,2)>"
    child = StateSchema({"item": Field(item), "tried": Field("int")})

    def work(s):
        busy = F.when(s["item"]["discount"] > 0.09, True).when(s["item"]["discount"] > 0.08, s["_attempt"] < 2).otherwise(False)
        return {"tried": s["_attempt"], "!": Fail(busy, "busy", "provider_rate_limit")}

    leaf = GraphBuilder(child).add_node("n", work, (retry(3),)).add_edge("n", END).set_entry("n").compile()
    schema = StateSchema({"items": Field(f"array<{item}>"), "tried": Field("array<int>", []), "errors": Field("array<struct<fan_out_index:string,category:string>>", []), "n": Field("bigint", 0)})
    spec = FanOut(leaf, "tried", "tried", items_field="items", item_field="item", error_policy="collect", errors_field="errors", count_field="n", on_empty="noop")
    g = GraphBuilder(schema).add_fan_out("f", spec).add_edge("f", END).set_entry("f").compile()
    out = run(g, schema.initial_state(order_items(spark, d)))
    spent = F.aggregate("tried", F.lit(0), lambda a, x: a + x) + 2 * F.size("errors")
    return out.select("o_orderkey", "n", spent.cast("string").alias("attempts"), F.size("errors").cast("long").alias("n_failed"))


# ------------------------------------------------------------------ checkpoints


def _saved_graph(store=None, fails: bool = True):
    inner = StateSchema({"x": Field("bigint"), "log": Field("array<string>", [], R.APPEND)})
    add = lambda n, bad: lambda s: {"x": s["x"] + 1, "log": F.array(F.lit(n)), "!": Fail(bad(s), n)}
    never, seventh = (lambda s: F.lit(False)), (lambda s: s["x"] % 7 == 0)
    child = GraphBuilder(inner).add_node("a", add("a", never)).add_node("b", add("b", seventh if fails else never)).add_edge("a", "b").add_edge("b", END).set_entry("a").compile()
    outer = StateSchema({"n": Field("bigint"), "trace": Field("array<string>", [], R.APPEND)}, version="v1")
    b = GraphBuilder(outer).add_node("first", lambda s: {"trace": F.array(F.lit("first"))}).add_subgraph("sub", child, Explicit({"x": "n"}, {"n": "x", "trace": "log"}))
    b.add_node("last", lambda s: {"trace": F.array(F.lit("last"))}).add_edge("first", "sub").add_edge("sub", "last").add_edge("last", END).set_entry("first")
    return (b.with_checkpoints(store) if store is not None else b).compile(), outer


def _saved_run(spark, d):
    store = checkpoints.CheckpointStore(spark, Scratch(spark, "store").root)
    g, schema = _saved_graph(store)
    rows = schema.initial_state(table(spark, d, "supplier", "s_suppkey"), n="s_suppkey")
    run(g, rows, invocation="s_suppkey").count()
    return store, schema, rows


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS invocation_id, CASE WHEN (s_suppkey + 1) % 7 = 0 THEN 'first,sub/a' ELSE 'first,sub/a,sub/b,sub,last' END AS nodes FROM supplier""")
def checkpoint_save_per_node(spark, d):
    """Every completed node is saved, those of subgraphs too; every seventh run fails in b."""
    store, _, _ = _saved_run(spark, d)
    return store.all().groupBy("invocation_id").agg(F.array_join(R.fold_append(F.col("node"), "seq"), ",").alias("nodes"))


@query("""SELECT s_suppkey, s_suppkey + 2 AS n, 'first,a,b,last' AS trace, CASE WHEN (s_suppkey + 1) % 7 = 0 THEN 2 ELSE 0 END AS ran FROM supplier""")
def checkpoint_resume_subgraph(spark, d):
    """Runs that had failed inside a subgraph go on there; the others have nothing left."""
    store, schema, rows = _saved_run(spark, d)
    g, _ = _saved_graph(fails=False)
    out = checkpoints.resume(g, rows, store.latest(), "s_suppkey")
    return out.select("s_suppkey", "n", F.array_join("trace", ",").alias("trace"), F.col("_step").cast("int").alias("ran"))


@query("SELECT CAST(user_id AS VARCHAR) AS invocation_id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type FROM events WHERE user_id = 7 GROUP BY 1")
def checkpoint_point_load(spark, d):
    store = checkpoints.CheckpointStore(spark, Scratch(spark, "point").root)
    store.save(table(spark, d, "events", "event_id", "user_id", "event_type").select(F.col("user_id").cast("string").alias("invocation_id"), F.col("event_id").alias("seq"), "event_type"))
    return store.load("7")


# ------------------------------------------------------------------ events


def _traced(spark, d):
    schema = StateSchema({"v": Field("double")})
    b = GraphBuilder(schema).add_node("load", lambda s: {"v": s["v"] * 2}).add_node("check", lambda s: {"!": Fail(s["v"] > 100_000, "dear")}).add_node("end", lambda s: {})
    b.add_edge("load", "check").add_conditional_edge("check", lambda s: F.when(s["v"] > 50_000, "nowhere").otherwise("end"), ("end",)).add_edge("end", END).set_entry("load")
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderdate").withColumn("ended", F.col("o_orderdate") + F.expr("interval 1 day"))
    return run(b.compile(), schema.initial_state(o, v="o_totalprice"), trace=True)


@query("""SELECT kind, e.node AS node, CASE WHEN kind = 'node_completed' THEN e.category END AS category, count(*) AS n FROM (
SELECT unnest(CASE WHEN v > 100000 THEN [{'node': 'load', 'category': NULL}, {'node': 'check', 'category': 'node_exception'}] WHEN v > 50000 THEN [{'node': 'load', 'category': NULL}, {'node': 'check', 'category': 'routing_error'}]
ELSE [{'node': 'load', 'category': NULL}, {'node': 'check', 'category': NULL}, {'node': 'end', 'category': NULL}] END) AS e FROM (SELECT o_totalprice * 2 AS v FROM orders)), (VALUES ('node_started'), ('node_completed')) k(kind) GROUP BY ALL""")
def node_event_log(spark, d):
    """Started and completed events; a bad edge is charged to the node before it."""
    e = Y.node_events(_traced(spark, d), "o_orderkey")
    return e.groupBy("kind", "node", "category").agg(F.count("*").alias("n"))


E_SQL = """SELECT o_orderkey, o_totalprice * 2 AS v, o_orderdate AS t FROM orders"""


@query(f"""SELECT 'invocation_started' AS kind, CAST(o_orderkey AS VARCHAR) AS invocation_id, NULL AS category, '{{}}' AS attributes, epoch_us(t) AS at_us FROM ({E_SQL}) UNION ALL
SELECT 'invocation_completed', CAST(o_orderkey AS VARCHAR), CASE WHEN v > 100000 THEN 'node_exception' WHEN v > 50000 THEN 'routing_error' END, CASE WHEN v > 50000 THEN '{{"steps":2}}' ELSE '{{"steps":3}}' END, epoch_us(t) + 86400000000 FROM ({E_SQL})""")
def invocation_event_log(spark, d):
    e = Y.invocation_events(_traced(spark, d).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).withColumn("ended", F.col("ended").cast("timestamp")), "o_orderkey", "o_orderdate", "ended")
    return e.select("kind", "invocation_id", "category", "attributes", F.unix_micros("at").alias("at_us"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'llm_failed' WHEN event_type = 'view' THEN 'embedding' WHEN event_type = 'click' THEN 'rerank' WHEN event_type = 'signup' THEN 'tool_call_failed' ELSE 'tool_call' END AS kind,
CASE WHEN event_type = 'error' THEN 'provider_unavailable' WHEN event_type = 'signup' THEN 'node_exception' END AS category, '{"items":' || CAST(user_id AS VARCHAR) || '}' AS attributes FROM events""")
def call_event_log(spark, d):
    """Calls of all kinds as events; failed ones have a kind of their own."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    e = e.withColumn("category", F.when(F.col("event_type") == "error", "provider_unavailable").when(F.col("event_type") == "signup", "node_exception"))
    made = None
    for what, types in (("llm", ["error"]), ("embedding", ["view"]), ("rerank", ["click"]), ("tool", ["signup", "purchase"])):
        one = Y.call_events(e.where(F.col("event_type").isin(types)), what, "event_id", "ts", attributes={"items": "user_id"})
        made = one if made is None else made.unionByName(one)
    return made.select(F.col("invocation_id").cast("long").alias("event_id"), "kind", "category", "attributes")


@query("""SELECT doc_id, '{"attempt":' || CAST(k AS VARCHAR) || ',"reason":"' || CASE WHEN doc_id % 3 = 0 THEN 'reask' ELSE 'transient' END || '"}' AS attributes FROM (SELECT doc_id, unnest(range(1, (doc_id % 4)::INT + 1)) AS k FROM documents)""")
def llm_retry_event_log(spark, d):
    t = table(spark, d, "documents", "doc_id").withColumn("attempts", F.col("doc_id") % 4 + 1).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    why = F.when(F.col("doc_id") % 3 == 0, "reask").otherwise("transient")
    reasons = F.array_join(F.array_repeat(why, (F.col("doc_id") % 4).cast("int")), ",")
    e = Y.retry_events(t.withColumn("reasons", reasons), "doc_id", "at")
    return e.select(F.col("invocation_id").cast("long").alias("doc_id"), "attributes")


@query("""SELECT o_orderkey, '{"concurrency":4,"error_policy":"collect","item_count":' || CAST(count(l_orderkey) AS VARCHAR) || '}' AS attributes FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def fanout_config_events(spark, d):
    o = order_items(spark, d, "o_orderdate")
    e = Y.fan_out_events(o, "o_orderkey", "price", F.coalesce(F.size("items"), F.lit(0)), "o_orderdate", concurrency=4, error_policy="collect")
    return e.select(F.col("invocation_id").cast("long").alias("o_orderkey"), "attributes")


@query("""WITH s AS (SELECT user_id, event_id, event_type, last_value(CASE event_type WHEN 'view' THEN CAST(event_id AS VARCHAR) WHEN 'click' THEN '' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS scope FROM events)
SELECT event_id, nullif(scope, '') AS scope FROM s WHERE event_type = 'purchase'""")
def tool_call_scope(spark, d):
    """A tool call belongs to the node that has started and not ended."""
    kind = F.when(F.col("event_type") == "view", "started").when(F.col("event_type") == "click", "completed").when(F.col("event_type") == "purchase", "tool")
    e = table(spark, d, "events", "event_id", "user_id", "event_type").select(F.col("user_id").alias("invocation_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_id").cast("string").alias("node"))
    return Y.tool_scopes(e).select(F.col("seq").alias("event_id"), "scope")


@query("""SELECT operation, bucket, count(*) AS n, CAST(sum(ms) AS VARCHAR) AS total FROM (SELECT CASE WHEN event_type = 'view' THEN 'embedding' ELSE 'rerank' END AS operation, event_id % 1000 AS ms,
CASE WHEN ms <= 10 THEN 0 WHEN ms <= 100 THEN 1 WHEN ms <= 500 THEN 2 ELSE 3 END AS bucket FROM events WHERE event_type IN ('view', 'click')) GROUP BY 1, 2""")
def metric_embedding_rerank(spark, d):
    """Durations of embedding and rerank calls by bucket."""
    e = table(spark, d, "events", "event_id", "event_type").where("event_type in ('view', 'click')")
    e = e.select(F.when(F.col("event_type") == "view", "embedding").otherwise("rerank").alias("operation"), (F.col("event_id") % 1000).alias("ms"))
    return E.histogram(e, F.col("ms"), [10, 100, 500], "operation").withColumn("total", F.col("total").cast("string"))


@query("""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '/' || CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS ids FROM orders""")
def correlation_accessors(spark, d):
    """A node reads the invocation's id and the correlation's, by default the same."""
    schema = StateSchema({"ids": Field("string")})
    g = _single(schema, lambda s: {"ids": F.concat_ws("/", Y.current_invocation(), Y.current_correlation())})
    o = table(spark, d, "orders", "o_orderkey", "o_custkey").withColumn("c", F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")))
    return run(g, schema.initial_state(Y.identified(o, "o_orderkey", "c"))).select("o_orderkey", "ids")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN substring(sha256('Hello {{ name }}'), 1, 16) WHEN lang = 'de' THEN substring(sha256('Hallo {{ name }}'), 1, 16) END AS prompt_version FROM documents")
def prompt_context(spark, d):
    """Calls carry the version of the prompt that was active."""
    t = spark.createDataFrame([("en", "Hello {{ name }}"), ("de", "Hallo {{ name }}")], "name string, template string")
    t = t.select("name", P.version(F.col("template")).alias("version"), P.template_hash(F.col("template")).alias("template_hash"))
    return Y.with_prompts(table(spark, d, "documents", "doc_id", F.col("lang").alias("prompt")), t).select("doc_id", "prompt_version")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN sha256(text) END AS shown, NULL AS hidden FROM documents")
def payload_privacy_gate(spark, d):
    """Payloads stay hidden unless they are asked for."""
    t = table(spark, d, "documents", "doc_id", "text")
    shown = T.payload(F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)), shown=True)
    return t.select("doc_id", shown.alias("shown"), T.payload(F.sha2("text", 256)).alias("hidden"))


# ------------------------------------------------------------------ providers and tools


def stub_embed(texts):
    """Length and first character; entries in falling order; refuses a request with a 'web' text at its head."""
    return [(i, [float(len(t)), float(ord(t[0]))]) for i, t in reversed(list(enumerate(texts)))]


@query("SELECT doc_id AS id, len(source)::DOUBLE AS size, ord(source)::DOUBLE AS head, CASE WHEN source = '' THEN 'provider_invalid_request' END AS category FROM documents")
def embed_provider(spark, d):
    """Embedding calls on the executors, in requests of 32 inputs."""
    e = providers.embedded(table(spark, d, "documents", "doc_id", "source"), stub_embed, "doc_id", "source", 32)
    return e.select("id", F.get("vector", F.lit(0)).alias("size"), F.get("vector", F.lit(1)).alias("head"), "category")


def stub_rerank(text, documents):
    """Documents by length; ties are left to the caller."""
    return [(i, float(len(x) % 10)) for i, x in enumerate(documents)]


@query("""SELECT conv_id AS id, r AS rank, i AS "index", s AS score FROM (SELECT conv_id, turn - first AS i, s, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, turn) AS r FROM (
SELECT conv_id, turn, (length(text) % 10)::DOUBLE AS s, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)) WHERE r <= 3""")
def rerank_provider(spark, d):
    """The turns of each conversation ranked by a provider in requests of 2, re-based and cut to 3."""
    c = table(spark, d, "conversations", "conv_id", "turn", "text").groupBy("conv_id").agg(R.fold_append(F.col("text"), "turn").alias("texts"))
    return providers.reranked(c.withColumn("query", F.lit("q")), stub_rerank, "conv_id", "query", "texts", 2, 3).select("id", "rank", "index", "score")


def stub_json(messages, config, attempt):
    """JSON with a number at the second attempt; names the tools that it was given."""
    i = messages[0]["id"]
    body = {"n": i if attempt else str(i), "tool": config["tools"][0]["function"]["name"], "strict": config["response_format"]["json_schema"]["strict"]}
    return {"text": json.dumps(body) if i % 10 else "no JSON"}


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 10 <> 0 THEN '{"n": ' || CAST(doc_id AS VARCHAR) || ', "tool": "look", "strict": true}' END AS text, CASE WHEN doc_id % 10 = 0 THEN 'structured_output_invalid' END AS category, CAST(2 AS BIGINT) AS attempts FROM documents""")
def complete_with_schema(spark, d):
    """Calls with a tool and a response schema; answers that break it are asked for again."""
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "tool": {"const": "look"}, "strict": {"type": "boolean"}}, "required": ["n", "tool", "strict"], "additionalProperties": False}
    again = completion.CallRetry(2, reask=lambda raw, reason: reason)
    out = completion.completed(
        table(spark, d, "documents", "doc_id", "source"), stub_json, "doc_id", "source", {"temperature": 0.0}, again, [{"name": "look", "parameters": {}}], "auto", schema, concurrency=4
    )
    return out.select("id", "text", "category", "attempts")


@query("""SELECT * FROM (VALUES ('fine', 'none'), ('twice', 'provider_invalid_request'), ('required_without', 'provider_invalid_request'), ('unknown_choice', 'provider_invalid_request'), ('auto_without', 'none'),
('array_schema', 'provider_invalid_request'), ('lost_reference', 'provider_invalid_request'), ('closed_schema', 'strict'), ('open_schema', 'not strict')) t("case", outcome)""")
def tool_and_schema_checks(spark, d):
    """Rules of tools, choices and response schemas; checked before any call."""
    closed = {"type": "object", "properties": {"x": {"type": "string"}}, "required": ["x"], "additionalProperties": False}
    strict = lambda s: lambda: "strict" if M.strict_supported(s) else "not strict"
    cases = {
        "fine": lambda: M.check_tools(["a", "b"], {"name": "a"}), "twice": lambda: M.check_tools(["a", "a"]), "required_without": lambda: M.check_tools([], "required"),
        "unknown_choice": lambda: M.check_tools(["a"], {"name": "z"}), "auto_without": lambda: M.check_tools([], "auto"), "array_schema": lambda: M.check_schema({"type": "array"}),
        "lost_reference": lambda: M.check_schema({"type": "object", "properties": {"x": {"$ref": "#/$defs/z"}}}), "closed_schema": strict(closed), "open_schema": strict({**closed, "required": []}),
    }

    def outcome(check) -> str:
        try:
            return check() or "none"
        except ProviderError as e:
            return e.category

    return spark.createDataFrame([(k, outcome(c)) for k, c in cases.items()], "case string, outcome string")


@query("""SELECT doc_id, 'text:' || source || '|inline_redacted:' || CAST(length(lang) AS VARCHAR) AS blocks FROM documents""")
def inline_redaction(spark, d):
    """Inline data in content blocks leaves only its size."""
    block = lambda kind, text, data: F.struct(F.lit(kind).alias("type"), text.alias("text"), data.alias("data"))
    none = F.lit(None).cast("string")
    b = M.redacted_blocks(F.array(block("text", F.col("source"), none), block("image", none, F.col("lang"))))
    shown = F.transform(b, lambda x: F.concat_ws(":", x["type"], F.coalesce(x["text"], x["byte_count"].cast("string"))))
    return table(spark, d, "documents", "doc_id", "lang", "source").select("doc_id", F.array_join(shown, "|").alias("blocks"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN '{"content":' || to_json(text) || ',"role":"assistant","tool_calls":[{"function":{"arguments":"{}","name":"look"},"id":"c' || CAST(turn AS VARCHAR) || '","type":"function"}]}'
WHEN role = 'user' THEN '{"content":[{"text":' || to_json(text) || ',"type":"text"},{"image_url":{"url":"http://h/i"},"type":"image_url"}],"role":"user"}' ELSE '{"content":' || to_json(text) || ',"role":"' || role || '"}' END AS wire,
CASE WHEN role = 'assistant' THEN 'c' || CAST(turn AS VARCHAR) || ':look:{}' ELSE '' END AS calls FROM conversations""")
def message_wire_tools_blocks(spark, d):
    """Tool calls and content blocks on the wire, and tool calls back from it."""
    m = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    call = F.struct(F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"), F.lit("look").alias("name"), F.lit("{}").alias("arguments"))
    block = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.alias("text"), F.lit(url).cast("string").alias("url"))
    blocks = F.when(F.col("role") == "user", F.array(block("text", F.col("text"), None), block("image", F.lit(None).cast("string"), "http://h/i"))).otherwise(F.array())
    w = m.withColumn("wire", completion.wire_message(F.col("role"), F.col("text"), None, F.array(call), blocks))
    back = completion.calls_from_wire(F.col("wire"))
    return w.select("conv_id", "turn", "wire", F.coalesce(F.array_join(F.transform(back, lambda c: F.concat_ws(":", c["id"], c["name"], c["arguments"])), ","), F.lit("")).alias("calls"))


@query("""WITH RECURSIVE t AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS n, 0 AS turns, '' AS said FROM part UNION ALL SELECT p_partkey, n // 3, turns + 1, said || CAST(n % 3 AS VARCHAR) FROM t WHERE n > 0)
SELECT p_partkey, turns, said FROM t WHERE n = 0""")
def tool_loop_digits(spark, d):
    """The model asks for a division until nothing is left; the tool divides."""
    rows = table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", F.col("p_size").cast("long").alias("n"), F.lit(0).alias("turns"), F.lit("").alias("said"), F.lit(False).alias("call"))
    step = lambda df: df.withColumn("call", F.col("n") > 0)
    tool = lambda df: df.withColumns({"said": F.concat("said", (F.col("n") % 3).cast("string")), "n": F.floor(F.col("n") / 3), "turns": F.col("turns") + 1})
    return completion.tool_loop(rows, step, tool, F.col("call")).select("p_partkey", "turns", "said")


# ------------------------------------------------------------------ templates


@query("""SELECT conv_id, 'Conversation ' || CAST(conv_id AS VARCHAR) || CASE WHEN count(*) > 5 THEN ' (long)' WHEN count(*) > 2 THEN ' (middle)' ELSE '' END || ':' || string_agg(' ' || CAST(r AS VARCHAR) || '.' || upper(role) || CASE WHEN r = n THEN '!' ELSE ';' END, '' ORDER BY turn) AS text
FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id""")
def prompt_template_blocks(spark, d):
    """Loops, conditions and filters, as one native expression."""
    template = (
        "Conversation {{ id }}{% if turns|count > 5 %} (long){% elif turns|count > 2 %} (middle){% else %}{% endif %}:"
        "{% for t in turns %} {{ loop.index }}.{{ t.role|upper }}{% if loop.last %}!{% else %};{% endif %}{% endfor %}{# done #}"
    )
    c = table(spark, d, "conversations", "conv_id", "turn", "role").groupBy("conv_id").agg(R.fold_append(F.struct("role", "turn"), "turn").alias("turns"))
    return c.select("conv_id", rendered_template(template, id=F.col("conv_id"), turns=F.col("turns")).alias("text"))


@query("""SELECT * FROM (VALUES ('greeting', 'production', 'Hello {{ name }}', 'sha256:' || sha256('Hello {{ name }}')), ('greeting', 'beta', 'Hi {{ name }}', 'sha256:' || sha256('Hi {{ name }}')), ('flat', NULL, 'Plain', 'sha256:' || sha256('Plain'))) t(name, label, template, template_hash)""")
def prompt_files(spark, d):
    """Templates read from a folder by label and name."""
    root = Scratch(spark, "prompts").root
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, text in (("production/greeting", "Hello {{ name }}"), ("beta/greeting", "Hi {{ name }}"), ("flat", "Plain")):
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.j2")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
    return templates(spark, root).select("name", "label", "template", "template_hash")
