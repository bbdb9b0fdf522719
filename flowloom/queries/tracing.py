"""What traces show, the order of isolation and retry, and sinks that come and go between runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.telemetry import trace_io
from ..plans.graph import END, Fail, GraphBuilder
from ..plans.program import isolate, retry, run
from ..plans.schema import Field, StateSchema
from ..session import table
from ..sources.scratch import Scratch
from ..streaming.delivery import Sinks, deliver, event_stream
from .registry import query


@query("""SELECT o_orderkey, '{' || CASE WHEN o_orderkey % 4 <> 0 THEN '"correlation_id":"' || CAST(o_custkey AS VARCHAR) || '",' ELSE '' END || '"entry_node":"price"}' AS stub,
CASE WHEN o_orderkey % 3 = 0 THEN 'order ' || CAST(o_orderkey AS VARCHAR) ELSE '{"n":' || CAST(o_orderkey AS VARCHAR) || ',"status":"' || o_orderstatus || '"}' END AS hooked,
'{"n":' || CAST(o_orderkey AS VARCHAR) || ',"status":"' || o_orderstatus || '"}' AS shown,
CASE WHEN o_orderkey % 3 = 0 THEN 'order ' || CAST(o_orderkey AS VARCHAR) ELSE '{' || CASE WHEN o_orderkey % 4 <> 0 THEN '"correlation_id":"' || CAST(o_custkey AS VARCHAR) || '",' ELSE '' END || '"entry_node":"price"}' END AS hooked_or_stub,
'{' || CASE WHEN o_orderkey % 4 <> 0 THEN '"correlation_id":"' || CAST(o_custkey AS VARCHAR) || '",' ELSE '' END || '"entry_node":"price"}' AS shared FROM orders""")
def trace_input_sourcing(spark, d):
    """A trace's input by the caller's hook, the state or a stub; a shared destination gets the stub."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    stub = {"entry_node": F.lit("price"), "correlation_id": F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey"))}
    state = {"n": F.col("o_orderkey"), "status": F.col("o_orderstatus")}
    hook = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    return o.select(
        "o_orderkey", trace_io(stub, state).alias("stub"), trace_io(stub, state, hook, shown=True).alias("hooked"), trace_io(stub, state, shown=True).alias("shown"),
        trace_io(stub, state, hook).alias("hooked_or_stub"), trace_io(stub, state, hook, shown=True, isolated=False).alias("shared"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN -1 WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS right_order, CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 3 = 0 THEN -1 ELSE 0 END AS wrong_order FROM orders""")
def isolation_outside_retry(spark, d):
    """Isolation outside sees what retry couldn't mend; inside it hides what retry would have mended."""
    def node(s):
        k, attempt = s["k"], s["_attempt"] if "_attempt" in s else F.lit(0)
        return {"out": attempt, "!": Fail((k % 10 == 0) | ((k % 3 == 0) & (attempt == 0)), "busy", "provider_rate_limit")}

    def out(*middleware):
        schema = StateSchema({"k": Field("bigint"), "out": Field("int")})
        g = GraphBuilder(schema).add_node("call", node, middleware).add_edge("call", END).set_entry("call").compile()
        return run(g, schema.initial_state(table(spark, d, "orders", "o_orderkey"), k="o_orderkey"))

    degraded = isolate({"out": F.lit(-1)})
    right, wrong = out(degraded, retry(3)), out(retry(3), degraded)
    return right.select("o_orderkey", F.col("out").alias("right_order")).join(wrong.select("o_orderkey", F.col("out").alias("wrong_order")), "o_orderkey")


@query("""SELECT sink, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events, (SELECT unnest(['first', 'always', 'second']) AS sink)
WHERE CASE sink WHEN 'first' THEN event_id % 2 = 0 WHEN 'second' THEN event_id % 2 = 1 ELSE true END GROUP BY sink""")
def stream_sinks_between_runs(spark, d):
    """Two runs of one stream: a sink that is detached after the first, one attached before the second, one that stays."""
    root = Scratch(spark, "sinks").root
    e = table(spark, d, "events", "event_id")
    to = lambda name: lambda batch, number: batch.withColumn("sink", F.lit(name)).write.mode("overwrite").parquet(f"{root}/out/{name}-{number}")
    sinks = Sinks({"always": to("always")})
    detach = sinks.attach("first", to("first"))
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{root}/in")
        deliver(event_stream(spark, f"{root}/in", e.schema), sinks, f"{root}/checkpoint").awaitTermination()
        if not half:
            detach()
            sinks.attach("second", to("second"))
    got = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/out")
    return got.groupBy("sink").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))
