"""Runs that break off and go on: lineage of invocations, numbers of saves, progress of fan-outs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reducers as R
from ..operators import checkpoints
from ..operators.typed_events import branch_events, branches_events, save_events
from ..plans.graph import END, Branch, Fail, FanOut, GraphBuilder
from ..plans.program import run
from ..plans.schema import Field, StateSchema
from ..session import table
from ..sources.scratch import Scratch
from .registry import query

_SCHEMA = StateSchema({"n": Field("bigint"), "trace": Field("array<string>", [], R.APPEND)}, version="v1")


def _graph(store, b_fails: bool, c_fails: bool):
    """Four nodes; b fails for multiples of 3, c for those of 5."""
    key = lambda s: s["n"] % 100_000  # noqa: E731  the row's key stays readable below the sums
    def node(name, add, bad):
        return lambda s: {"n": s["n"] + add * 100_000, "trace": F.array(F.lit(name)), "!": Fail(bad(s), name)}

    b = GraphBuilder(_SCHEMA).add_node("a", node("a", 1, lambda s: F.lit(False))).add_node("b", node("b", 2, lambda s: (key(s) % 3 == 0) & F.lit(b_fails)))
    b.add_node("c", node("c", 3, lambda s: (key(s) % 5 == 0) & F.lit(c_fails))).add_node("d", node("d", 4, lambda s: F.lit(False)))
    return b.add_edge("a", "b").add_edge("b", "c").add_edge("c", "d").add_edge("d", END).set_entry("a").with_checkpoints(store).compile()


def _resumed_twice(spark, d):
    """A run, and two resumed ones, each with a store object of its own over one folder."""
    folder = Scratch(spark, "lineage").root
    store = lambda: checkpoints.CheckpointStore(spark, folder)
    rows = _SCHEMA.initial_state(table(spark, d, "supplier", "s_suppkey", "s_nationkey"), n="s_suppkey")
    run(_graph(store(), True, True), rows, invocation="s_suppkey", correlation="s_nationkey").count()
    checkpoints.resume(_graph(store(), False, True), rows, store().heads(), "s_suppkey", run_id="r1").count()
    out = checkpoints.resume(_graph(store(), False, False), rows, store().heads(), "s_suppkey", run_id="r2")
    return store(), out


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS root_id, CAST(s_suppkey AS VARCHAR) || CASE WHEN s_suppkey % 5 = 0 THEN '~r2' WHEN s_suppkey % 3 = 0 THEN '~r1' ELSE '' END AS invocation_id,
  CASE WHEN s_suppkey % 15 = 0 THEN CAST(s_suppkey AS VARCHAR) || '~r1' WHEN s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS resumed_from,
  CAST(s_nationkey AS VARCHAR) AS correlation_id, CAST(CASE WHEN s_suppkey % 15 = 0 THEN 7 WHEN s_suppkey % 5 = 0 THEN 6 WHEN s_suppkey % 3 = 0 THEN 5 ELSE 4 END AS BIGINT) AS seq,
  'a,b,c,d' AS nodes, s_suppkey + 1000000 AS n FROM supplier""")
def checkpoint_lineage(spark, d):
    """The last record of each root after two resumed runs: a new invocation each, one correlation id, rising numbers."""
    store, _ = _resumed_twice(spark, d)
    n = F.get_json_object("state", "$.n").cast("bigint")
    nodes = F.array_join(F.transform("completed_positions", lambda p: p["path"]), ",")
    return store.heads().select("root_id", "invocation_id", "resumed_from", "correlation_id", "seq", nodes.alias("nodes"), n.alias("n"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS invocation_id, CAST(s_nationkey AS VARCHAR) AS correlation_id, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1 WHEN s_suppkey % 5 = 0 THEN 2 ELSE 4 END AS BIGINT) AS completed_node_count FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR) || '~r1', CAST(s_nationkey AS VARCHAR), CAST(CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 4 END AS BIGINT) FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT CAST(s_suppkey AS VARCHAR) || '~r2', CAST(s_nationkey AS VARCHAR), 4 FROM supplier WHERE s_suppkey % 5 = 0""")
def checkpoint_list_runs(spark, d):
    """Summaries of every invocation that a run and its resumed runs have saved."""
    store, _ = _resumed_twice(spark, d)
    return store.list().select("invocation_id", "correlation_id", "completed_node_count")


@query("""SELECT s_suppkey, s_suppkey + 1000000 AS n, 'a,b,c,d' AS trace, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 0 END AS BIGINT) AS ran FROM supplier""")
def checkpoint_resume_chain(spark, d):
    """What the second resumed run returns: every row's whole state, whatever it still had to do."""
    _, out = _resumed_twice(spark, d)
    return out.select("s_suppkey", "n", F.array_join("trace", ",").alias("trace"), F.col("_step").alias("ran"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS invocation_id, CAST(8 AS BIGINT) AS seq, s_suppkey + 1000000 + 1 AS n FROM supplier WHERE s_suppkey % 7 <> 0""")
def checkpoint_run_again(spark, d):
    """A second run of the same invocations from another store object; some are deleted between compactions."""
    folder = Scratch(spark, "again").root
    for more in (0, 1):
        rows = _SCHEMA.initial_state(table(spark, d, "supplier", "s_suppkey"), n=F.col("s_suppkey") + more)
        run(_graph(checkpoints.CheckpointStore(spark, folder), False, False), rows, invocation="s_suppkey").count()
    store = checkpoints.CheckpointStore(spark, folder)
    gone = store.latest().where(F.col("root_id").cast("bigint") % 7 == 0).select("invocation_id", (F.col("seq") + 1).alias("seq"))
    gone.withColumn("_deleted", F.lit(True)).write.mode("append").parquet(f"{folder}/records")
    store.compact()
    return store.latest().select("invocation_id", "seq", F.get_json_object("state", "$.n").cast("bigint").alias("n"))


class _Breaking(checkpoints.CheckpointStore):
    """A store whose second flush fails, as if the driver were lost."""

    flushed = 0

    def save_progress(self, instances):
        if self.flushed:
            raise InterruptedError("broken off")
        self.flushed += 1
        super().save_progress(instances)


def _flushing(store):
    child = StateSchema({"x": Field("bigint"), "out": Field("bigint")})
    leaf = GraphBuilder(child).add_node("square", lambda s: {"out": s["x"] * s["x"]}).add_edge("square", END).set_entry("square").compile()
    schema = StateSchema({"items": Field("array<bigint>"), "outs": Field("array<bigint>", []), "total": Field("bigint", 0)})
    b = GraphBuilder(schema).add_node("load", lambda s: {"total": F.lit(0)}).add_fan_out("each", FanOut(leaf, "outs", "out", items_field="items", item_field="x", on_empty="noop", flushes=3))
    b.add_node("sum", lambda s: {"total": F.aggregate(s["outs"], F.lit(0).cast("bigint"), lambda a, x: a + x)})
    b.add_edge("load", "each").add_edge("each", "sum").add_edge("sum", END).set_entry("load")
    return b.with_checkpoints(store).compile(), schema


@query("""WITH q AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) - 1 AS i FROM lineitem)
SELECT l_orderkey, CAST(sum(x * x) AS BIGINT) AS total, string_agg(CAST(x * x AS VARCHAR), ',' ORDER BY i) AS outs, count_if(i % 3 = 0) AS first_run, count_if(i % 3 <> 0) AS resumed_run FROM q GROUP BY 1""")
def fanout_progress_resumed(spark, d):
    """A run broken off after a third of its instances; the resumed one runs the others only."""
    folder = Scratch(spark, "flushes").root
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("bigint").alias("q")))), lambda x: x["q"])
    g, schema = _flushing(_Breaking(spark, folder))
    # both runs take the same rows: grouped once
    rows = schema.initial_state(Scratch(spark, "orders", "zstd").save(lines.groupBy("l_orderkey").agg(items.alias("items"))))
    try:
        run(g, rows, invocation="l_orderkey").count()
    except InterruptedError:
        pass
    store = checkpoints.CheckpointStore(spark, folder)
    g, _ = _flushing(store)
    out = checkpoints.resume(g, rows, store.heads(), "l_orderkey", run_id="r1")
    saved = store.progress().groupBy(F.col("root_id").cast("bigint").alias("root")).agg(
        F.count_if(F.col("invocation_id") == F.col("root_id")).alias("first_run"), F.count_if(F.col("invocation_id") != F.col("root_id")).alias("resumed_run")
    )
    done = out.select("l_orderkey", "total", F.array_join(F.col("outs").cast("array<string>"), ",").alias("outs"))
    return done.join(saved, done["l_orderkey"] == saved["root"]).drop("root")


# ------------------------------------------------------------------ events of saves and branches


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS c FROM supplier),
n AS (SELECT k, c, CAST(k AS VARCHAR) AS i, 'a' AS node, 1 AS seq, 1 AS done FROM s UNION ALL SELECT k, c, CAST(k AS VARCHAR), 'b', 2, 2 FROM s WHERE k % 3 <> 0 UNION ALL SELECT k, c, CAST(k AS VARCHAR), 'c', 3, 3 FROM s WHERE k % 3 <> 0 AND k % 5 <> 0
  UNION ALL SELECT k, c, CAST(k AS VARCHAR), 'd', 4, 4 FROM s WHERE k % 3 <> 0 AND k % 5 <> 0
  UNION ALL SELECT k, c, CAST(k AS VARCHAR) || '~r1', 'b', 3, 2 FROM s WHERE k % 3 = 0 UNION ALL SELECT k, c, CAST(k AS VARCHAR) || '~r1', 'c', 4, 3 FROM s WHERE k % 3 = 0 AND k % 5 <> 0 UNION ALL SELECT k, c, CAST(k AS VARCHAR) || '~r1', 'd', 5, 4 FROM s WHERE k % 3 = 0 AND k % 5 <> 0
  UNION ALL SELECT k, c, CAST(k AS VARCHAR) || '~r2', 'c', CASE WHEN k % 3 = 0 THEN 6 ELSE 5 END, 3 FROM s WHERE k % 5 = 0 UNION ALL SELECT k, c, CAST(k AS VARCHAR) || '~r2', 'd', CASE WHEN k % 3 = 0 THEN 7 ELSE 6 END, 4 FROM s WHERE k % 5 = 0)
SELECT 'checkpoint_saved' AS kind, i AS invocation_id, CAST(c AS VARCHAR) AS correlation_id, node, '{"completed":' || CAST(done AS VARCHAR) || ',"seq":' || CAST(seq AS VARCHAR) || '}' AS attributes FROM n""")
def checkpoint_saved_events(spark, d):
    """An event for every save of a run and of two resumed ones."""
    store, _ = _resumed_twice(spark, d)
    return save_events(store.all()).select("kind", "invocation_id", "correlation_id", "node", "attributes")


def _branching(spark, d):
    schema = StateSchema({"k": Field("bigint"), "size": Field("bigint"), "a": Field("bigint"), "b": Field("bigint"), "errors": Field("array<struct<branch_name:string,category:string,message:string,cause_type:string>>", [])})
    inner = StateSchema({"x": Field("bigint")})
    child = GraphBuilder(inner).add_node("w", lambda s: {"x": s["x"] * 2, "!": Fail(s["x"] % 7 == 0, "seven")}).add_edge("w", END).set_entry("w").compile()
    spec = {"graph": Branch(child, inputs={"x": "size"}, outputs={"a": "x"}), "call": Branch(call=lambda s: {"b": s["size"] + 1, "!": Fail(s["k"] % 11 == 0, "eleven")}, when=lambda s: s["size"] % 2 == 0)}
    g = GraphBuilder(schema).add_branches("both", spec, error_policy="collect", errors_field="errors").add_edge("both", END).set_entry("both").compile()
    return run(g, schema.initial_state(table(spark, d, "part", "p_partkey", "p_size"), k="p_partkey", size="p_size")), spec


@query("""WITH b AS (SELECT p_partkey AS k, p_size AS s, unnest(['graph', 'call']) AS name FROM part), r AS (SELECT k, name, CASE WHEN (name = 'graph' AND s % 7 = 0) OR (name = 'call' AND k % 11 = 0) THEN 'node_exception' END AS bad, CASE name WHEN 'graph' THEN 0 ELSE 1 END AS i FROM b WHERE name = 'graph' OR s % 2 = 0)
SELECT 'branch_started' AS kind, CAST(k AS VARCHAR) AS invocation_id, 'both/' || name AS node, NULL::VARCHAR AS category, '{"index":' || CAST(i AS VARCHAR) || '}' AS attributes FROM r
UNION ALL SELECT 'branch_completed', CAST(k AS VARCHAR), 'both/' || name, bad, '{"index":' || CAST(i AS VARCHAR) || '}' FROM r""")
def branch_event_log(spark, d):
    """Started and completed events of branches, called ones as well as graphs; skipped ones have none."""
    out, spec = _branching(spark, d)
    state = {n: F.col(n) for n in ("k", "size")}
    shown = {name: b.when(state) if b.when is not None else F.lit(True) for name, b in spec.items()}
    return branch_events(out.withColumn("at", F.lit(None).cast("timestamp")), "p_partkey", "both", shown, "at", "errors").select("kind", "invocation_id", "node", "category", "attributes")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS invocation_id, 'parallel_branches' AS kind, '{"branch_count":2,"branches":"graph,call","error_policy":"collect"}' AS attributes FROM part""")
def branch_config_events(spark, d):
    """The configuration of a branches node for each run."""
    out, spec = _branching(spark, d)
    e = branches_events(out.withColumn("at", F.lit(None).cast("timestamp")), "p_partkey", "both", list(spec), "at", "collect")
    return e.select("invocation_id", "kind", "attributes")
