"""Cycles inside subgraphs, branches and fan-out instances, against recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reducers as R
from ..plans.graph import END, Branch, Explicit, Fail, FanOut, GraphBuilder
from ..plans.program import run
from ..plans.schema import Field, StateSchema
from ..session import table
from .registry import query


def _halving(fails: bool = False):
    """Halves x until it is 1 at most, counting rounds; with `fails`, 7 can't be halved."""
    schema = StateSchema({"x": Field("bigint"), "rounds": Field("bigint", 0), "seen": Field("array<bigint>", [], R.APPEND)})
    b = GraphBuilder(schema).add_node("look", lambda s: {"seen": F.array(s["x"]), "!": Fail((s["x"] == 7) & F.lit(fails), "seven")})
    b.add_node("halve", lambda s: {"x": F.floor(s["x"] / 2), "rounds": s["rounds"] + 1})
    b.add_conditional_edge("look", lambda s: F.when(s["x"] > 1, "halve").otherwise(END), ("halve", END)).add_edge("halve", "look").set_entry("look")
    return b.compile()


def _euclid():
    """Greatest common divisor of a and b."""
    schema = StateSchema({"a": Field("bigint"), "b": Field("bigint"), "steps": Field("bigint", 0)})
    b = GraphBuilder(schema).add_node("look", lambda s: {}).add_node("step", lambda s: {"a": s["b"], "b": F.try_mod(s["a"], s["b"]), "steps": s["steps"] + 1})
    b.add_conditional_edge("look", lambda s: F.when(s["b"] == 0, END).otherwise("step"), ("step", END)).add_edge("step", "look").set_entry("look")
    return b.compile()


def _lines(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("bigint").alias("q")))), lambda x: x["q"])
    return lines.groupBy("l_orderkey").agg(items.alias("items"))


@query("""WITH RECURSIVE r AS (
  SELECT l_orderkey, l_linenumber, l_quantity AS q, CAST(l_quantity AS BIGINT) AS x, CAST(0 AS BIGINT) AS n, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS seen FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, q, x // 2, n + 1, seen || '>' || CAST(x // 2 AS VARCHAR) FROM r WHERE x > 1)
SELECT l_orderkey, string_agg(CAST(n AS VARCHAR), ',' ORDER BY l_linenumber, q) AS rounds, string_agg(seen, ' ' ORDER BY l_linenumber, q) AS seen FROM r WHERE x <= 1 GROUP BY 1""")
def fanout_looping_instances(spark, d):
    """Each line of an order loops a number of rounds of its own; results are in line order."""
    schema = StateSchema({"items": Field("array<bigint>"), "rounds": Field("array<bigint>", []), "seen": Field("array<array<bigint>>", [])})
    spec = FanOut(_halving(), "rounds", "rounds", items_field="items", item_field="x", extra_outputs={"seen": "seen"})
    g = GraphBuilder(schema).add_fan_out("each", spec).add_edge("each", END).set_entry("each").compile()
    out = run(g, schema.initial_state(_lines(spark, d)))
    seen = F.transform("seen", lambda x: F.array_join(x.cast("array<string>"), ">"))
    return out.select("l_orderkey", F.array_join(F.col("rounds").cast("array<string>"), ",").alias("rounds"), F.array_join(seen, " ").alias("seen"))


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS x FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, x, list_filter([x, x // 2, x // 4, x // 8, x // 16], lambda v: v >= 1) AS seen FROM q),
f AS (SELECT l_orderkey, l_linenumber, x, list_contains(seen, 7) AS bad, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, x) - 1 AS i, CAST(floor(log2(x) + 1e-9) AS BIGINT) AS n FROM s)
SELECT l_orderkey, coalesce(string_agg(CASE WHEN NOT bad THEN CAST(n AS VARCHAR) END, ',' ORDER BY i), '') AS rounds,
  coalesce(string_agg(CASE WHEN bad THEN CAST(i AS VARCHAR) END, ',' ORDER BY i), '') AS failed FROM f GROUP BY 1""")
def fanout_looping_collect(spark, d):
    """Instances that fail in some round are collected; the others go on."""
    schema = StateSchema({"items": Field("array<bigint>"), "rounds": Field("array<bigint>", []), "errors": Field("array<struct<fan_out_index:string,category:string>>", [])})
    spec = FanOut(_halving(fails=True), "rounds", "rounds", items_field="items", item_field="x", error_policy="collect", errors_field="errors")
    g = GraphBuilder(schema).add_fan_out("each", spec).add_edge("each", END).set_entry("each").compile()
    out = run(g, schema.initial_state(_lines(spark, d)))
    return out.select(
        "l_orderkey", F.array_join(F.col("rounds").cast("array<string>"), ",").alias("rounds"), F.array_join(F.transform("errors", lambda e: e["fan_out_index"]), ",").alias("failed")
    )


@query("""WITH RECURSIVE r AS (SELECT ps, k, CAST(ps AS BIGINT) AS a, CAST(k AS BIGINT) AS b, CAST(0 AS BIGINT) AS n FROM (SELECT p_partkey AS k, p_size AS ps FROM part)
  UNION ALL SELECT ps, k, b, a % b, n + 1 FROM r WHERE b <> 0)
SELECT k AS p_partkey, a AS divisor, n AS steps, a = 1 AS coprime FROM r WHERE b = 0""")
def subgraph_loop(spark, d):
    """A subgraph that loops until it is done, and a node behind it."""
    schema = StateSchema({"size": Field("bigint"), "key": Field("bigint"), "divisor": Field("bigint"), "steps": Field("bigint"), "coprime": Field("boolean")})
    b = GraphBuilder(schema).add_subgraph("gcd", _euclid(), Explicit({"a": "size", "b": "key"}, {"divisor": "a", "steps": "steps"}))
    b.add_node("judge", lambda s: {"coprime": s["divisor"] == 1}).add_edge("gcd", "judge").add_edge("judge", END).set_entry("gcd")
    out = run(b.compile(), schema.initial_state(table(spark, d, "part", "p_partkey", "p_size"), size="p_size", key="p_partkey"))
    return out.select("p_partkey", "divisor", "steps", "coprime")


@query("""WITH RECURSIVE g AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS a, CAST(p_partkey AS BIGINT) AS b FROM part WHERE p_size % 2 = 1 UNION ALL SELECT k, b, a % b FROM g WHERE b <> 0),
h AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS x, CAST(0 AS BIGINT) AS n FROM part UNION ALL SELECT k, x // 2, n + 1 FROM h WHERE x > 1)
SELECT h.k AS p_partkey, n AS rounds, g.a AS divisor FROM h LEFT JOIN g ON g.k = h.k AND g.b = 0 WHERE h.x <= 1""")
def branches_loop(spark, d):
    """Two branches that loop, each its own number of rounds; one only for odd sizes."""
    schema = StateSchema({"size": Field("bigint"), "key": Field("bigint"), "rounds": Field("bigint"), "divisor": Field("bigint")})
    odd = lambda s: s["size"] % 2 == 1
    spec = {"halve": Branch(_halving(), inputs={"x": "size"}, outputs={"rounds": "rounds"}), "gcd": Branch(_euclid(), inputs={"a": "size", "b": "key"}, outputs={"divisor": "a"}, when=odd)}
    g = GraphBuilder(schema).add_branches("both", spec).add_edge("both", END).set_entry("both").compile()
    out = run(g, schema.initial_state(table(spark, d, "part", "p_partkey", "p_size"), size="p_size", key="p_partkey"))
    return out.select("p_partkey", "rounds", "divisor")


@query("""WITH RECURSIVE r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS x, CAST(0 AS BIGINT) AS n FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, x // 2, n + 1 FROM r WHERE x > 1),
o AS (SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS total FROM r WHERE x <= 1 GROUP BY 1),
c AS (SELECT o_custkey, string_agg(CAST(total AS VARCHAR), ',' ORDER BY o_orderkey) AS totals FROM orders JOIN o ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_custkey, totals FROM c""")
def fanout_looping_nested(spark, d):
    """A fan-out over a customer's orders, inside it one over an order's lines, whose instances loop."""
    order = StateSchema({"items": Field("array<bigint>"), "rounds": Field("array<bigint>", []), "total": Field("bigint")})
    b = GraphBuilder(order).add_fan_out("lines", FanOut(_halving(), "rounds", "rounds", items_field="items", item_field="x"))
    b.add_node("sum", lambda s: {"total": F.aggregate(s["rounds"], F.lit(0).cast("bigint"), lambda a, x: a + x)}).add_edge("lines", "sum").add_edge("sum", END).set_entry("lines")
    schema = StateSchema({"orders": Field("array<array<bigint>>"), "totals": Field("array<bigint>", [])})
    g = GraphBuilder(schema).add_fan_out("orders", FanOut(b.compile(), "totals", "total", items_field="orders", item_field="items")).add_edge("orders", END).set_entry("orders").compile()
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey").join(_lines(spark, d), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "items"))), lambda x: x["items"]).alias("orders"))
    return run(g, schema.initial_state(rows)).select("o_custkey", F.array_join(F.col("totals").cast("array<string>"), ",").alias("totals"))
