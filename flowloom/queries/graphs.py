"""Reducers, nodes, routing, projections, fan-out, branches, retries, checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reducers as R
from ..functions import telemetry as T
from ..operators import attempts, checkpoints, fan_out
from ..operators.events import timings
from ..plans.graph import END, Branch, Explicit, Fail, FanOut, GraphBuilder, Migration, Migrations, NameMatching, SameName, Write
from ..plans.program import isolate, retry, run
from ..plans.schema import Field, StateSchema
from ..session import table
from .registry import query

#: Keys that order lineitems of an order without ties.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
_LINES = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


# ------------------------------------------------------------------ reducers


@query("SELECT user_id, arg_max_null(event_type, event_id) AS last_type, count(*) AS n_updates FROM events GROUP BY user_id")
def reduce_last_write_wins(spark, d):
    return table(spark, d, "events", "user_id", "event_id", "event_type").groupBy("user_id").agg(R.fold_last(F.col("event_type"), "event_id").alias("last_type"), F.count("*").alias("n_updates"))


@query("SELECT user_id, string_agg(event_type, '|' ORDER BY event_id) AS joined FROM events GROUP BY user_id")
def reduce_append(spark, d):
    e = table(spark, d, "events", "user_id", "event_id", "event_type")
    return e.groupBy("user_id").agg(F.array_join(R.fold_append(F.col("event_type"), "event_id"), "|").alias("joined"))


@query("SELECT user_id, event_type AS key, arg_max_null(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def reduce_merge(spark, d):
    """A map's entries as rows: the key is grouped by as well, so no map is gathered."""
    e = table(spark, d, "events", "user_id", "event_id", "event_type", "value")
    return e.groupBy("user_id", F.col("event_type").alias("key")).agg(R.fold_last(F.col("value"), "event_id").alias("value"))


@query(f"""SELECT o_custkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY o_orderkey, {_LINES}) AS parts
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def reduce_concat_flatten(spark, d):
    """Lists of part keys by order, concatenated and flattened by customer."""
    lines = table(spark, d, "lineitem", "l_orderkey", *LINE_ORDER).groupBy("l_orderkey").agg(R.fold_append(F.col("l_partkey").cast("string"), *LINE_ORDER).alias("parts"))
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.array_join(R.fold_concat(F.col("parts"), "o_orderkey"), ",").alias("parts"))


@query("SELECT user_id, event_type AS key, arg_max_null(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def reduce_merge_all(spark, d):
    """One map per user and day, folded per user from left to right."""
    e = table(spark, d, "events", "user_id", "event_id", "event_type", "value", "ts").withColumn("day", F.to_date("ts"))
    last = e.groupBy("user_id", "day", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("last"))
    daily = last.groupBy("user_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "value"))).alias("m"))
    return daily.groupBy("user_id").agg(R.fold_merge(F.col("m"), "day").alias("m")).select("user_id", F.explode("m").alias("key", "value"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'O' THEN [o_orderpriority, o_orderstatus] ELSE [o_orderpriority] END IS NULL AS failed,
array_to_string(CASE WHEN o_orderstatus = 'O' THEN [o_orderpriority, o_orderstatus] ELSE [o_orderpriority] END, '|') AS tags FROM orders""")
def reduce_error_rows(spark, d):
    """An append of null is a reducer_error; the row keeps its prior list."""
    schema = StateSchema({"status": Field("string"), "tags": Field("array<string>", reducer=R.APPEND)})

    def node(s):
        bad = F.when(s["status"] == "F", F.lit(None)).otherwise(F.array(s["status"]))
        return {"tags": Write(bad, s["status"].isin("F", "O"))}

    g = GraphBuilder(schema).add_node("tag", node).add_edge("tag", END).set_entry("tag").compile()
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    out = run(g, schema.initial_state(o, status="o_orderstatus", tags=F.array("o_orderpriority")))
    return out.select("o_orderkey", F.col("_error.category").eqNullSafe("reducer_error").alias("failed"), F.array_join("tags", "|").alias("tags"))


# ------------------------------------------------------------------ nodes and edges


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS note FROM orders""")
def node_partial_presence(spark, d):
    """Absent isn't null: F writes a value, O writes null, others write nothing."""
    schema = StateSchema({"status": Field("string"), "note": Field("string")})

    def node(s):
        return {"note": Write(F.when(s["status"] == "F", F.lit("closed")), s["status"].isin("F", "O"))}

    g = GraphBuilder(schema).add_node("note", node).add_edge("note", END).set_entry("note").compile()
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return run(g, schema.initial_state(o, status="o_orderstatus", note="o_orderpriority")).select("o_orderkey", "note")


def _routing():
    schema = StateSchema({"priority": Field("string"), "status": Field("string"), "lane": Field("string", "none"), "trace": Field("array<string>", [], R.APPEND)})

    def lane(name):
        return lambda s: {"lane": name, "trace": F.array(F.lit(name))}

    b = GraphBuilder(schema).add_node("start", lambda s: {"trace": F.array(F.lit("start"))})
    for n in ("urgent", "normal", "closed"):
        b.add_node(n, lane(n)).add_edge(n, "end")
    b.add_node("end", lambda s: {"trace": F.array(F.lit("end"))}).add_edge("end", END).set_entry("start")

    def choose(s):
        return F.when(s["status"] == "F", "closed").when(s["priority"].startswith("1") | s["priority"].startswith("2"), "urgent").otherwise("normal")

    return schema, b.add_conditional_edge("start", choose, ("urgent", "normal", "closed")).compile()


@query("""SELECT lane, count(*) AS n_rows, 'start|' || lane || '|end' AS trace FROM (
SELECT CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'urgent' ELSE 'normal' END AS lane FROM orders) GROUP BY lane""")
def route_conditional(spark, d):
    schema, g = _routing()
    o = table(spark, d, "orders", "o_orderstatus", "o_orderpriority")
    out = run(g, schema.initial_state(o, priority="o_orderpriority", status="o_orderstatus"))
    return out.groupBy("lane", F.array_join("trace", "|").alias("trace")).agg(F.count("*").alias("n_rows"))


@query("""SELECT CASE WHEN o_orderstatus = 'P' THEN 'routing_error' END AS category, count(*) AS n_rows FROM orders GROUP BY 1""")
def route_error_rows(spark, d):
    """A choice of an undeclared node fails the row with routing_error."""
    schema = StateSchema({"status": Field("string")})
    b = GraphBuilder(schema).add_node("a", lambda s: {}).add_node("b", lambda s: {}).add_edge("b", END).set_entry("a")
    g = b.add_conditional_edge("a", lambda s: F.when(s["status"] == "P", "nowhere").otherwise("b"), ("b",)).compile()
    out = run(g, schema.initial_state(table(spark, d, "orders", "o_orderstatus"), status="o_orderstatus"))
    return out.groupBy(F.col("_error.category").alias("category")).agg(F.count("*").alias("n_rows"))


@query("""WITH RECURSIVE h AS (SELECT o_orderkey, o_totalprice AS total, 0 AS rounds FROM orders UNION ALL SELECT o_orderkey, total / 2, rounds + 1 FROM h WHERE total > 50000)
SELECT o_orderkey, CAST(max(rounds) AS BIGINT) AS rounds, min(total) AS total FROM h GROUP BY o_orderkey""")
def cycle_halving(spark, d):
    """A cycle: halve the total until it is no more than a bound."""
    schema = StateSchema({"total": Field("double"), "rounds": Field("bigint", 0)})
    b = GraphBuilder(schema).add_node("check", lambda s: {}).add_node("halve", lambda s: {"total": s["total"] / 2, "rounds": s["rounds"] + 1})
    b.add_edge("halve", "check").add_conditional_edge("check", lambda s: F.when(s["total"] > 50000, "halve").otherwise(END), ("halve", END)).set_entry("check")
    out = run(b.compile(), schema.initial_state(table(spark, d, "orders", "o_orderkey", "o_totalprice"), total="o_totalprice"), max_rounds=40)
    return out.select("o_orderkey", "rounds", "total")


@query("""SELECT CAST(step AS BIGINT) AS step, node, count(*) AS n_rows FROM (
SELECT unnest([0, 1, 2]) AS step, unnest(['start', CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'urgent' ELSE 'normal' END, 'end']) AS node FROM orders) GROUP BY ALL""")
def execution_order(spark, d):
    """The traced path of every row, by step."""
    schema, g = _routing()
    o = table(spark, d, "orders", "o_orderstatus", "o_orderpriority")
    out = run(g, schema.initial_state(o, priority="o_orderpriority", status="o_orderstatus"), trace=True)
    return out.select(F.posexplode("_path").alias("step", "node")).groupBy(F.col("step").cast("long").alias("step"), "node").agg(F.count("*").alias("n_rows"))


# ------------------------------------------------------------------ projections


def _projected(spark, d, projection):
    parent = StateSchema({"shared": Field("bigint"), "parent_only": Field("double"), "note": Field("string")})
    child = StateSchema({"shared": Field("bigint", 100), "child_only": Field("bigint", 7), "note": Field("string", "child")})
    c = GraphBuilder(child).add_node("work", lambda s: {"shared": s["shared"] + 1, "child_only": s["child_only"] + s["shared"], "note": F.concat(s["note"], F.lit("+"))}).add_edge("work", END).set_entry("work").compile()
    g = GraphBuilder(parent).add_subgraph("sub", c, projection).add_edge("sub", END).set_entry("sub").compile()
    s = table(spark, d, "supplier", "s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    out = run(g, parent.initial_state(s, shared="s_nationkey", parent_only="s_acctbal", note="s_name"))
    return out.select("s_suppkey", "shared", "parent_only", "note")


@query("SELECT s_suppkey, CAST(101 AS BIGINT) AS shared, s_acctbal AS parent_only, 'child+' AS note FROM supplier")
def projection_field_match(spark, d):
    return _projected(spark, d, NameMatching())


@query("SELECT s_suppkey, CAST(s_nationkey + 7 AS BIGINT) AS shared, s_acctbal AS parent_only, s_name AS note FROM supplier")
def projection_explicit(spark, d):
    return _projected(spark, d, Explicit({"shared": "shared"}, {"shared": "child_only"}))


@query("SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS shared, s_acctbal AS parent_only, s_name || '+' AS note FROM supplier")
def projection_declared(spark, d):
    return _projected(spark, d, SameName(("note",), ("note",)))


# ------------------------------------------------------------------ fan-out


def _line(c):
    return F.struct(F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_shipdate"), *c)


def order_items(spark, d, *more):
    """Orders with their lineitems as an ordered array; none for orders without any."""
    lines = table(spark, d, "lineitem", "l_orderkey", *LINE_ORDER, "l_discount")
    price = F.struct(F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_discount").cast("decimal(18,2)").alias("discount"))
    items = lines.groupBy("l_orderkey").agg(R.fold_append(price, *LINE_ORDER).alias("items"))
    return table(spark, d, "orders", "o_orderkey", *more).join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


_ITEM = "struct<price:decimal(18,2),discount:decimal(18,2)>"


def _net_child(fail_over: float | None = None):
    child = StateSchema({"item": Field(_ITEM), "net": Field("decimal(18,4)"), "cut": Field("decimal(18,2)")})

    def work(s):
        out = {"net": (s["item"]["price"] * (1 - s["item"]["discount"])).cast("decimal(18,4)"), "cut": s["item"]["discount"]}
        if fail_over is not None:
            out["!"] = Fail(s["item"]["discount"] > fail_over, "discount", "node_exception")
        return out

    return GraphBuilder(child).add_node("net", work).add_edge("net", END).set_entry("net").compile()


_PARENT = {
    "items": Field(f"array<{_ITEM}>"), "nets": Field("array<decimal(18,4)>", [], R.APPEND), "n_items": Field("bigint", 0), "cuts": Field("array<decimal(18,2)>", [], R.APPEND),
    "errors": Field("array<struct<fan_out_index:string,category:string>>", []), "revenue": Field("decimal(18,4)"), "lane": Field("string"), "priority": Field("string"),
}


def _total(xs):
    return F.aggregate(xs, F.lit(0).cast("decimal(18,4)"), lambda a, x: (a + x).cast("decimal(18,4)"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'normal' END AS lane, count(l_orderkey) AS n_items,
CAST(coalesce(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(18,4))), 0) AS DECIMAL(18,4))::VARCHAR AS revenue
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def fanout_order_revenue(spark, d):
    """load -> fan-out over the items -> route by priority -> summarize."""
    schema = StateSchema(_PARENT)
    spec = FanOut(_net_child(), "nets", "net", items_field="items", item_field="item", count_field="n_items", on_empty="noop")
    b = GraphBuilder(schema).add_node("load", lambda s: {}).add_fan_out("price", spec).add_edge("load", "price")
    b.add_node("urgent", lambda s: {"lane": "urgent"}).add_node("normal", lambda s: {"lane": "normal"})
    b.add_conditional_edge("price", lambda s: F.when(s["priority"].startswith("1"), "urgent").otherwise("normal"), ("urgent", "normal"))
    b.add_node("summarize", lambda s: {"revenue": _total(s["nets"])}).add_edge("urgent", "summarize").add_edge("normal", "summarize").add_edge("summarize", END).set_entry("load")
    out = run(b.compile(), schema.initial_state(order_items(spark, d, "o_orderpriority"), priority="o_orderpriority"))
    return out.select("o_orderkey", "lane", "n_items", F.col("revenue").cast("string").alias("revenue"))


@query("SELECT p_partkey, coalesce(string_agg(CAST(i * 2 AS VARCHAR), ',' ORDER BY i), '') AS doubled, CAST(p_size AS BIGINT) AS n FROM part LEFT JOIN LATERAL (SELECT unnest(range(p_size)) AS i) ON true GROUP BY p_partkey, p_size")
def fanout_count_mode(spark, d):
    """p_size instances of a child that counts for itself; instance results keep their order."""
    child = StateSchema({"item": Field("int"), "out": Field("string")})
    c = GraphBuilder(child).add_node("w", lambda s: {"out": (s["item"] * 2).cast("string")}).add_edge("w", END).set_entry("w").compile()
    schema = StateSchema({"size": Field("int"), "outs": Field("array<string>", [], R.APPEND), "n": Field("bigint", 0)})
    spec = FanOut(c, "outs", "out", count=lambda s: s["size"], item_field="item", count_field="n", on_empty="noop")
    g = GraphBuilder(schema).add_fan_out("f", spec).add_edge("f", END).set_entry("f").compile()
    out = run(g, schema.initial_state(table(spark, d, "part", "p_partkey", "p_size"), size="p_size"))
    return out.select("p_partkey", F.array_join("outs", ",").alias("doubled"), "n")


@query("""SELECT o_orderkey, count(l_orderkey) AS n_items, count(CASE WHEN l_discount > 0.08 THEN 1 END) AS n_failed,
CAST(coalesce(sum(CASE WHEN NOT l_discount > 0.08 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(18,4)) END), 0) AS DECIMAL(18,4))::VARCHAR AS revenue
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def fanout_collect_errors(spark, d):
    """Failed instances leave the list and are recorded; the others count."""
    schema = StateSchema(_PARENT)
    spec = FanOut(_net_child(0.08), "nets", "net", items_field="items", item_field="item", count_field="n_items", on_empty="noop", error_policy="collect", errors_field="errors")
    b = GraphBuilder(schema).add_fan_out("price", spec).add_node("sum", lambda s: {"revenue": _total(s["nets"])}).add_edge("price", "sum").add_edge("sum", END).set_entry("price")
    out = run(b.compile(), schema.initial_state(order_items(spark, d)))
    return out.select("o_orderkey", "n_items", F.size("errors").cast("long").alias("n_failed"), F.col("revenue").cast("string").alias("revenue"))


@query("""SELECT o_orderkey, CASE WHEN coalesce(bool_or(l_discount > 0.08), false) THEN 'node_exception' END AS category,
CASE WHEN coalesce(bool_or(l_discount > 0.08), false) THEN 0 ELSE count(l_orderkey) END AS n_items FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def fanout_fail_fast(spark, d):
    """One failed instance fails the row, which keeps its state from before the fan-out."""
    schema = StateSchema(_PARENT)
    spec = FanOut(_net_child(0.08), "nets", "net", items_field="items", item_field="item", count_field="n_items", on_empty="noop")
    g = GraphBuilder(schema).add_fan_out("price", spec).add_edge("price", END).set_entry("price").compile()
    out = run(g, schema.initial_state(order_items(spark, d)))
    return out.select("o_orderkey", F.col("_error.category").alias("category"), "n_items")


@query("SELECT o_orderkey, CAST(0 AS BIGINT) AS n_items, CAST(0 AS BIGINT) AS n_nets FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def fanout_empty_noop(spark, d):
    """Orders without lineitems: an empty list and a count of 0."""
    schema = StateSchema(_PARENT)
    spec = FanOut(_net_child(), "nets", "net", items_field="items", item_field="item", count_field="n_items", on_empty="noop")
    g = GraphBuilder(schema).add_fan_out("price", spec).add_edge("price", END).set_entry("price").compile()
    out = run(g, schema.initial_state(order_items(spark, d)))
    return out.where("n_items = 0 and _error is null").select("o_orderkey", "n_items", F.size("nets").cast("long").alias("n_nets"))


@query("""SELECT category, refined, count(*) AS n_rows FROM (SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'node_exception' END AS category,
CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'fan_out_empty' END AS refined FROM orders) GROUP BY ALL""")
def fanout_empty_raise(spark, d):
    schema = StateSchema(_PARENT)
    spec = FanOut(_net_child(), "nets", "net", items_field="items", item_field="item")
    g = GraphBuilder(schema).add_fan_out("price", spec).add_edge("price", END).set_entry("price").compile()
    out = run(g, schema.initial_state(order_items(spark, d)))
    return out.groupBy(F.col("_error.category").alias("category"), F.col("_error.fan_out_category").alias("refined")).agg(F.count("*").alias("n_rows"))


@query(f"""SELECT o_orderkey, coalesce(string_agg(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(18,4))::VARCHAR, ',' ORDER BY {_LINES}), '') AS nets,
coalesce(string_agg(CAST(l_discount AS DECIMAL(18,2))::VARCHAR, ',' ORDER BY {_LINES}), '') AS cuts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def fanout_extra_outputs(spark, d):
    """Two lists in the same order."""
    schema = StateSchema(_PARENT)
    spec = FanOut(_net_child(), "nets", "net", items_field="items", item_field="item", extra_outputs={"cuts": "cut"}, on_empty="noop")
    g = GraphBuilder(schema).add_fan_out("price", spec).add_edge("price", END).set_entry("price").compile()
    out = run(g, schema.initial_state(order_items(spark, d)))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("o_orderkey", text("nets").alias("nets"), text("cuts").alias("cuts"))


@query(f"""SELECT c_custkey, coalesce(string_agg('[' || parts || ']', ',' ORDER BY o_orderkey), '') AS nested FROM customer LEFT JOIN (
SELECT o_custkey, o_orderkey, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY {_LINES}), '') AS parts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) ON o_custkey = c_custkey GROUP BY 1""")
def fanout_nested(spark, d):
    """Customers -> orders -> lineitems; inner empties keep their outer row."""
    lines = table(spark, d, "lineitem", "l_orderkey", *LINE_ORDER).groupBy("l_orderkey").agg(R.fold_append(F.col("l_partkey"), *LINE_ORDER).alias("parts"))
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per = orders.groupBy("o_custkey").agg(R.fold_append(F.struct(F.coalesce("parts", F.array().cast("array<bigint>")).alias("parts")), "o_orderkey").alias("orders"))
    rows = table(spark, d, "customer", "c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    leaf = StateSchema({"item": Field("bigint"), "out": Field("string")})
    lg = GraphBuilder(leaf).add_node("w", lambda s: {"out": s["item"].cast("string")}).add_edge("w", END).set_entry("w").compile()
    mid = StateSchema({"item": Field("struct<parts:array<bigint>>"), "parts": Field("array<bigint>", []), "outs": Field("array<string>", [], R.APPEND), "text": Field("string")})
    mg = (
        GraphBuilder(mid).add_node("open", lambda s: {"parts": s["item"]["parts"]})
        .add_fan_out("inner", FanOut(lg, "outs", "out", items_field="parts", item_field="item", on_empty="noop"))
        .add_node("close", lambda s: {"text": F.concat(F.lit("["), F.array_join(s["outs"], ","), F.lit("]"))})
        .add_edge("open", "inner").add_edge("inner", "close").add_edge("close", END).set_entry("open").compile()
    )
    top = StateSchema({"orders": Field("array<struct<parts:array<bigint>>>"), "texts": Field("array<string>", [], R.APPEND)})
    g = GraphBuilder(top).add_fan_out("outer", FanOut(mg, "texts", "text", items_field="orders", item_field="item", on_empty="noop")).add_edge("outer", END).set_entry("outer").compile()
    return run(g, top.initial_state(rows)).select("c_custkey", F.array_join("texts", ",").alias("nested"))


@query(f"""SELECT o_orderkey, coalesce(string_agg(CASE WHEN l_quantity > 45 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END, ',' ORDER BY {_LINES}), '') AS kept,
count(l_orderkey) AS n_instances, count(CASE WHEN l_quantity > 45 THEN 1 END) AS n_failed FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def fanout_row_instances(spark, d):
    """Instances as rows, as a provider client needs them, and the ordered fan-in."""
    lines = table(spark, d, "lineitem", "l_orderkey", *LINE_ORDER)
    item = F.struct("l_partkey", "l_quantity")
    rows = table(spark, d, "orders", "o_orderkey").join(lines.groupBy("l_orderkey").agg(R.fold_append(item, *LINE_ORDER).alias("items")), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    child = lambda df: df.withColumns({"part": F.col("item.l_partkey").cast("string"), "bad": F.col("item.l_quantity") > 45})
    out = fan_out.mapped(rows.select("o_orderkey", "items"), "o_orderkey", "items", child, {"kept": "part"}, failed="bad")
    return out.select("o_orderkey", F.array_join("kept", ",").alias("kept"), F.col("n_instances"), F.col("n_failed"))


# ------------------------------------------------------------------ branches


@query("SELECT p_partkey, p_brand || '|' || p_type || '|' || CAST(p_size AS VARCHAR) AS labels FROM part")
def branches_merge_order(spark, d):
    """Three branches append to one list: in declared order, whatever ends first."""
    schema = StateSchema({"brand": Field("string"), "type": Field("string"), "size": Field("int"), "labels": Field("array<string>", [], R.APPEND)})

    def add(field):
        return Branch(call=lambda s: {"labels": F.array(s[field].cast("string"))})

    g = GraphBuilder(schema).add_branches("b", {"one": add("brand"), "two": add("type"), "three": add("size")}).add_edge("b", END).set_entry("b").compile()
    out = run(g, schema.initial_state(table(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_size"), brand="p_brand", type="p_type", size="p_size"))
    return out.select("p_partkey", F.array_join("labels", "|").alias("labels"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'unset' END AS flag, c_mktsegment AS segment FROM customer")
def branches_when_skip(spark, d):
    """A branch whose condition doesn't hold contributes nothing."""
    schema = StateSchema({"balance": Field("double"), "name": Field("string"), "flag": Field("string", "unset"), "segment": Field("string")})
    child = StateSchema({"seg": Field("string")})
    c = GraphBuilder(child).add_node("w", lambda s: {}).add_edge("w", END).set_entry("w").compile()
    branches = {
        "debt": Branch(call=lambda s: {"flag": "debt"}, when=lambda s: s["balance"] < 0),
        "copy": Branch(graph=c, inputs={"seg": "name"}, outputs={"segment": "seg"}),
    }
    g = GraphBuilder(schema).add_branches("b", branches).add_edge("b", END).set_entry("b").compile()
    out = run(g, schema.initial_state(table(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment"), balance="c_acctbal", name="c_mktsegment"))
    return out.select("c_custkey", "flag", "segment")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'unset' ELSE 'paid' END AS paid, s_name AS name, CASE WHEN s_acctbal < 0 THEN 'pay:node_exception' ELSE '' END AS errors FROM supplier")
def branches_collect_errors(spark, d):
    """Failed branches are recorded, the others' contributions stay."""
    record = "array<struct<branch_name:string,category:string,message:string,cause_type:string>>"
    schema = StateSchema({"balance": Field("double"), "source": Field("string"), "paid": Field("string", "unset"), "name": Field("string"), "errors": Field(record, [])})
    branches = {
        "pay": Branch(call=lambda s: {"paid": "paid", "!": Fail(s["balance"] < 0, "negative")}),
        "name": Branch(call=lambda s: {"name": s["source"]}),
    }
    g = GraphBuilder(schema).add_branches("b", branches, "collect", "errors").add_edge("b", END).set_entry("b").compile()
    out = run(g, schema.initial_state(table(spark, d, "supplier", "s_suppkey", "s_acctbal", "s_name"), balance="s_acctbal", source="s_name"))
    return out.select("s_suppkey", "paid", "name", F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["branch_name"], e["category"])), ",").alias("errors"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'parallel_branches_branch_failed' END AS category, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_name END AS name FROM supplier")
def branches_fail_fast(spark, d):
    """One failed branch fails the row; the other branches' contributions are dropped."""
    schema = StateSchema({"balance": Field("double"), "source": Field("string"), "name": Field("string")})
    branches = {"name": Branch(call=lambda s: {"name": s["source"]}), "pay": Branch(call=lambda s: {"!": Fail(s["balance"] < 0, "negative")})}
    g = GraphBuilder(schema).add_branches("b", branches).add_edge("b", END).set_entry("b").compile()
    out = run(g, schema.initial_state(table(spark, d, "supplier", "s_suppkey", "s_acctbal", "s_name"), balance="s_acctbal", source="s_name"))
    return out.select("s_suppkey", F.col("_error.category").alias("category"), "name")


# ------------------------------------------------------------------ retries and isolation


@query("""WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
f AS (SELECT user_id, min(CASE WHEN event_type <> 'error' OR n = 2 THEN n END) AS k, max(n) AS m FROM a WHERE n < 3 GROUP BY user_id)
SELECT f.user_id, CAST(coalesce(k, m) AS BIGINT) AS attempt, event_type <> 'error' AS succeeded FROM f JOIN a ON a.user_id = f.user_id AND a.n = coalesce(k, m)""")
def retry_first_success(spark, d):
    """A user's events as attempts, `error` being transient: the first success within three."""
    from pyspark.sql import Window

    e = table(spark, d, "events", "user_id", "event_id", "event_type")
    n = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    e = e.withColumn("n", n).where("n < 3")
    return attempts.outcome(e, "user_id", "n", F.col("event_type") == "error", F.lit(True), 3)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN 'attempt ' || CAST(o_orderkey % 4 AS VARCHAR) END AS answer, CASE WHEN o_orderkey % 4 = 3 THEN 'provider_rate_limit' END AS category FROM orders""")
def retry_node(spark, d):
    """A node that succeeds at attempt key % 4 under three attempts."""
    schema = StateSchema({"need": Field("bigint"), "answer": Field("string")})

    def call(s):
        return {"answer": F.concat(F.lit("attempt "), s["_attempt"].cast("string")), "!": Fail(s["_attempt"] < s["need"], "busy", "provider_rate_limit")}

    g = GraphBuilder(schema).add_node("call", call, [retry(3)]).add_edge("call", END).set_entry("call").compile()
    out = run(g, schema.initial_state(table(spark, d, "orders", "o_orderkey"), need=F.col("o_orderkey") % 4))
    return out.select("o_orderkey", "answer", F.col("_error.category").alias("category"))


@query("SELECT CAST(a AS BIGINT) AS attempt, least(30.0, pow(2.0, a))::DOUBLE AS bound FROM range(10) t(a)")
def retry_backoff_bound(spark, d):
    return spark.range(10).select(F.col("id").alias("attempt"), T.backoff_bound(F.col("id")).alias("bound"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN -1.0 ELSE value END AS value FROM events")
def isolation_degraded(spark, d):
    """Failing rows get the degraded update and go on."""
    schema = StateSchema({"kind": Field("string"), "value": Field("double")})

    def work(s):
        return {"!": Fail(s["kind"] == "error", "bad event", "provider_unavailable")}

    g = GraphBuilder(schema).add_node("work", work, [isolate({"value": -1.0}, catch=("provider_unavailable",))]).add_edge("work", END).set_entry("work").compile()
    out = run(g, schema.initial_state(table(spark, d, "events", "event_id", "event_type", "value"), kind="event_type"))
    return out.where("_error is null").select("event_id", "value")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'provider_unavailable' WHEN event_type = 'view' THEN NULL ELSE event_type END AS category,
CASE WHEN event_type = 'error' THEN 'root' WHEN event_type = 'view' THEN 'plain' ELSE 'own' END AS message FROM events""")
def cause_chain_category(spark, d):
    """The outermost real link with a category decides; carriers are passed over."""
    link = lambda carrier, category, message: F.struct(F.lit(carrier).alias("carrier"), category.cast("string").alias("category"), F.lit(message).alias("message"))
    kind = F.col("event_type")
    chain = (
        F.when(kind == "error", F.array(link(True, F.lit("node_exception"), "wrap"), link(False, F.lit(""), "plain"), link(False, F.lit("provider_unavailable"), "root")))
        .when(kind == "view", F.array(link(True, F.lit("node_exception"), "wrap"), link(False, F.lit(None), "plain")))
        .otherwise(F.array(link(False, kind, "own"), link(False, F.lit("other"), "root")))
    )
    return table(spark, d, "events", "event_id", "event_type").select("event_id", T.cause_category(chain).alias("category"), T.cause_message(chain).alias("message"))


@query("SELECT event_id, CAST(date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS VARCHAR) AS duration_us FROM events")
def timing_records(spark, d):
    e = timings(table(spark, d, "events", "event_id", "user_id", "ts"), "user_id", "ts", "event_id")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return e.select("event_id", (us("next_at") - us("ts")).cast("string").alias("duration_us"))


# ------------------------------------------------------------------ checkpoints


def _saves(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value", "ts")
    return e.select(F.col("user_id").cast("string").alias("invocation_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("correlation_id"), "value", F.col("ts").alias("last_saved_at"))


@query("SELECT CAST(user_id AS VARCHAR) AS invocation_id, max(event_id) AS seq, arg_max(event_type, event_id) AS correlation_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def checkpoint_latest(spark, d):
    return checkpoints.latest(_saves(spark, d).drop("last_saved_at"))


@query("""SELECT invocation_id, n AS completed_node_count FROM (SELECT CAST(user_id AS VARCHAR) AS invocation_id, count(*) AS n, arg_max(event_type, event_id) AS c FROM events GROUP BY user_id) WHERE c = 'click'""")
def checkpoint_list(spark, d):
    """Summaries of the latest records of one correlation id."""
    s = _saves(spark, d)
    records = s.groupBy("invocation_id").agg(F.max_by("correlation_id", "seq").alias("correlation_id"), F.max("last_saved_at").alias("last_saved_at"), F.collect_list("seq").alias("completed_positions"))
    return checkpoints.listing(records, "click").select("invocation_id", "completed_node_count")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def checkpoint_resume_skip(spark, d):
    """Planned work without what is completed."""
    done = table(spark, d, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return checkpoints.remaining(table(spark, d, "orders", "o_orderkey", "o_custkey"), done, "o_orderkey")


@query("SELECT CAST(user_id AS VARCHAR) AS invocation_id, count(*) AS n_saves, CAST(floor(count(*) / 8) * 8 AS BIGINT) AS n_flushed FROM events GROUP BY user_id")
def checkpoint_batch_flush(spark, d):
    return checkpoints.visible_saves(_saves(spark, d), "invocation_id", "seq", 8)


@query("""SELECT l_orderkey AS o_orderkey, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS n_completed, count(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 1 END) AS n_in_flight,
count(CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'N' THEN 1 END) AS n_not_started, count(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 1 END) AS n_errors FROM lineitem GROUP BY 1""")
def checkpoint_fan_out_progress(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linestatus", "l_returnflag")
    state = F.when(F.col("l_linestatus") == "F", "completed").when(F.col("l_returnflag") == "N", "in_flight").otherwise("not_started")
    inst = lines.select(F.col("l_orderkey").alias("o_orderkey"), state.alias("state"), ((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")).alias("result_is_error"))
    return checkpoints.fan_out_progress(inst, "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'resumed' ELSE 'whole' END || CASE WHEN o_orderstatus = 'F' THEN '|second' ELSE '|first|second' END AS trace FROM orders""")
def checkpoint_resume_run(spark, d):
    """Rows with a saved position begin behind it, from their saved state."""
    schema = StateSchema({"trace": Field("array<string>", [], R.APPEND)})
    node = lambda name: lambda s: {"trace": F.array(F.lit(name))}
    g = GraphBuilder(schema).add_node("first", node("first")).add_node("second", node("second")).add_edge("first", "second").add_edge("second", END).set_entry("first").compile()
    saved = F.col("o_orderstatus") == "F"
    rows = schema.initial_state(table(spark, d, "orders", "o_orderkey", "o_orderstatus"), trace=F.array(F.when(saved, "resumed").otherwise("whole")))
    return run(g, rows, start=F.when(saved, "second").otherwise("first")).select("o_orderkey", F.array_join("trace", "|").alias("trace"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'v1' WHEN o_orderstatus = 'O' THEN 'v2' ELSE 'v3' END AS was, CASE WHEN o_orderstatus = 'P' THEN 'kept' ELSE 'added' END AS risk,
CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || '!' ELSE o_orderpriority END AS objective FROM orders""")
def migration_chain(spark, d):
    """Records of three schema versions through their chains to the current one."""
    v = F.when(F.col("o_orderstatus") == "F", "v1").when(F.col("o_orderstatus") == "O", "v2").otherwise("v3")
    rec = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").select(
        "o_orderkey", v.alias("schema_version"), v.alias("was"), F.col("o_orderpriority").alias("objective"), F.when(v == "v3", F.lit("kept")).alias("risk")
    )
    steps = Migrations([Migration("v1", "v2", lambda s: {"objective": F.concat(s["objective"], F.lit("!"))}), Migration("v2", "v3", lambda s: {"risk": F.lit("added")})])
    return checkpoints.migrated(rec, steps, "v3", {"objective": "string", "risk": "string"}).select("o_orderkey", "was", "risk", "objective")
