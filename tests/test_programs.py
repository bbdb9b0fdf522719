"""Graphs over DataFrames: merge rules, failures, fan-out, branches, cycles, middleware."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.errors import FlowError, RunError
from flowloom.functions import reducers as R
from flowloom.plans.graph import END, Branch, Explicit, Fail, FanOut, GraphBuilder, Write
from flowloom.plans.program import isolate, retry, run, short_circuit
from flowloom.plans.schema import Field, StateSchema


def one(schema, node, *middleware):
    return GraphBuilder(schema).add_node("n", node, middleware).add_edge("n", END).set_entry("n").compile()


def result(spark, graph, rows, kind, **kw):
    return run(graph, graph.schema.initial_state(spark.createDataFrame(rows, kind)), **kw)


LISTS = "prior array<int>, update array<int>"


@pytest.mark.parametrize(
    "reducer,kind,prior,update,want",
    [
        (R.LAST_WRITE_WINS, "int", 1, None, None),
        (R.APPEND, "array<int>", [1], [2, 2], [1, 2, 2]),
        (R.MERGE, "map<string,int>", {"a": 1, "b": 2}, {"b": 3, "c": 4}, {"a": 1, "b": 3, "c": 4}),
    ],
)
def test_merge_rules(spark, reducer, kind, prior, update, want):
    df = spark.createDataFrame([(prior, update)], f"p {kind}, u {kind}")
    assert df.select(reducer.merge(F.col("p"), F.col("u"))).first()[0] == want


def test_flattening_rules(spark):
    df = spark.createDataFrame([([1], [[2], [], [3, 4]], {"a": 1}, [{"a": 2}, {"b": 3}, {"a": 4}])], "p array<int>, u array<array<int>>, m map<string,int>, ms array<map<string,int>>")
    r = df.select(R.CONCAT_FLATTEN.merge(F.col("p"), F.col("u")), R.MERGE_ALL.merge(F.col("m"), F.col("ms"))).first()
    assert r[0] == [1, 2, 3, 4] and r[1] == {"a": 4, "b": 3}
    bad = spark.createDataFrame([([1], [[2], None])], "p array<int>, u array<array<int>>")
    assert bad.select(R.CONCAT_FLATTEN.bad(F.col("p"), F.col("u"))).first()[0]


def test_absent_null_and_error(spark):
    schema = StateSchema({"k": Field("int"), "v": Field("string", "start"), "xs": Field("array<int>", [1], R.APPEND)})

    def node(s):
        return {"v": Write(F.when(s["k"] == 1, "set"), s["k"] < 3), "xs": F.when(s["k"] == 4, F.lit(None)).otherwise(F.array(s["k"])), "!": Fail(s["k"] == 5, "five")}

    out = {r["k"]: r for r in result(spark, one(schema, node), [(k,) for k in range(1, 6)], "k int").collect()}
    assert [out[k]["v"] for k in (1, 2, 3)] == ["set", None, "start"]
    assert out[4]["_error"]["category"] == "reducer_error" and out[4]["xs"] == [1] and out[4]["v"] == "start"
    assert out[5]["_error"]["category"] == "node_exception" and out[5]["_error"]["message"] == "five" and out[5]["xs"] == [1]
    assert out[1]["_step"] == 1 and out[5]["_at"] == "n"


def test_undeclared_fields_and_strict_runs(spark):
    schema = StateSchema({"k": Field("int")})
    with pytest.raises(FlowError, match="state_validation_error"):
        result(spark, one(schema, lambda s: {"zz": 1}), [(1,)], "k int")
    with pytest.raises(FlowError):
        schema.initial_state(spark.range(1), zz=F.lit(1))
    with pytest.raises(RunError):
        result(spark, one(schema, lambda s: {"!": Fail(s["k"] == 1)}), [(1,)], "k int", strict=True)


def test_later_nodes_skip_failed_rows(spark):
    schema = StateSchema({"k": Field("int"), "seen": Field("array<string>", [], R.APPEND)})
    mark = lambda n, fail=None: lambda s: {"seen": F.array(F.lit(n)), **({"!": Fail(s["k"] == fail)} if fail else {})}
    b = GraphBuilder(schema).add_node("a", mark("a")).add_node("b", mark("b", 1)).add_node("c", mark("c")).add_edge("a", "b").add_edge("b", "c").add_edge("c", END).set_entry("a")
    out = {r["k"]: r for r in result(spark, b.compile(), [(1,), (2,)], "k int", trace=True).collect()}
    assert out[1]["seen"] == ["a"] and out[1]["_path"] == ["a", "b"] and out[2]["seen"] == ["a", "b", "c"]


def test_cycle_has_a_limit(spark):
    schema = StateSchema({"k": Field("int")})
    b = GraphBuilder(schema).add_node("n", lambda s: {"k": s["k"] + 1}).add_conditional_edge("n", lambda s: F.when(s["k"] < 5, "n").otherwise(END), ("n", END)).set_entry("n")
    assert [r["k"] for r in result(spark, b.compile(), [(0,), (9,)], "k int").orderBy("k").collect()] == [5, 10]
    with pytest.raises(RunError, match="still moving"):
        result(spark, b.compile(), [(0,)], "k int", max_rounds=3)


LEAF = StateSchema({"item": Field("int"), "extra": Field("int", 0), "result": Field("int")})


def fan(spec, more=None):
    schema = StateSchema({"items": Field("array<int>"), "base": Field("int", 100), "out": Field("array<int>", [], R.APPEND), "n": Field("int", -1), "errors": Field("array<struct<fan_out_index:string,category:string>>", []), "last": Field("array<int>", [7])})
    return GraphBuilder(schema).add_fan_out("f", spec).add_edge("f", END).set_entry("f").compile()


def leaf(fail=None):
    return one(LEAF, lambda s: {"result": s["item"] * 10 + s["extra"], **({"!": Fail(s["item"] == fail)} if fail is not None else {})})


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=6), min_size=1, max_size=6))
def test_fan_in_keeps_instance_order(spark, lists):
    spec = FanOut(leaf(), "out", "result", items_field="items", item_field="item", inputs={"extra": "base"}, count_field="n", on_empty="noop")
    out = result(spark, fan(spec), [(i, xs) for i, xs in enumerate(lists)], "id int, items array<int>").collect()
    got = {r["id"]: (r["out"], r["n"]) for r in out}
    assert got == {i: ([None if x is None else x * 10 + 100 for x in xs], len(xs)) for i, xs in enumerate(lists)}


def test_fan_out_policies(spark):
    rows, kind = [([1, 2, 3],), ([4],), ([],)], "items array<int>"
    spec = FanOut(leaf(2), "out", "result", items_field="items", item_field="item", error_policy="collect", errors_field="errors", count_field="n", on_empty="noop")
    out = result(spark, fan(spec), rows, kind).collect()
    assert [(r["out"], r["n"], [tuple(e) for e in r["errors"]]) for r in out] == [([10, 30], 3, [("1", "node_exception")]), ([40], 1, []), ([], 0, [])]
    spec = FanOut(leaf(2), "out", "result", items_field="items", item_field="item")
    out = result(spark, fan(spec), rows, kind).collect()
    assert [r["out"] for r in out] == [[], [40], []]
    assert [r["_error"] and (r["_error"]["category"], r["_error"]["fan_out_category"]) for r in out] == [("node_exception", None), None, ("node_exception", "fan_out_empty")]


def test_fan_out_counts_and_empty_targets(spark):
    spec = FanOut(leaf(), "last", "result", count=lambda s: s["base"], item_field="item", on_empty="noop")
    out = result(spark, fan(spec), [(2,), (0,), (-1,)], "base int").collect()
    assert [r["last"] for r in out] == [[0, 10], [], [7]]  # last_write_wins: an empty list overwrites
    assert out[2]["_error"]["fan_out_category"] == "fan_out_invalid_count"
    spec = FanOut(leaf(), "last", "result", count=1, concurrency=0)
    assert result(spark, fan(spec), [(2,)], "base int").first()["_error"]["fan_out_category"] == "fan_out_invalid_concurrency"


def test_branches_fold_in_declared_order(spark):
    schema = StateSchema({"k": Field("int"), "xs": Field("array<string>", [], R.APPEND), "v": Field("string", "old")})
    add = lambda n, when=None: Branch(call=lambda s: {"xs": F.array(F.lit(n)), "v": n}, when=when)
    g = GraphBuilder(schema).add_branches("b", {"z": add("z"), "a": add("a", lambda s: s["k"] == 1), "m": add("m")}).add_edge("b", END).set_entry("b").compile()
    assert [(r["xs"], r["v"]) for r in result(spark, g, [(1,), (2,)], "k int").orderBy("k").collect()] == [(["z", "a", "m"], "m"), (["z", "m"], "m")]


def test_branch_graphs_and_all_skipped(spark):
    schema = StateSchema({"k": Field("int"), "r": Field("int", 0), "errors": Field("array<struct<branch_name:string,category:string,message:string,cause_type:string>>")})
    never = Branch(graph=leaf(), inputs={"item": "k"}, outputs={"r": "result"}, when=lambda s: F.lit(False))
    g = GraphBuilder(schema).add_branches("b", {"x": never}, "collect", "errors").add_edge("b", END).set_entry("b").compile()
    assert [(r["r"], r["errors"]) for r in result(spark, g, [(3,)], "k int").collect()] == [(0, [])]
    g = GraphBuilder(schema).add_branches("b", {"x": Branch(graph=leaf(), inputs={"item": "k"}, outputs={"r": "result"})}).add_edge("b", END).set_entry("b").compile()
    assert result(spark, g, [(3,)], "k int").first()["r"] == 30


def test_subgraph_failure_keeps_the_parent(spark):
    schema = StateSchema({"item": Field("int"), "result": Field("int", 1)})
    g = GraphBuilder(schema).add_subgraph("s", leaf(2), Explicit({"item": "item"}, {"result": "result"})).add_edge("s", END).set_entry("s").compile()
    out = {r["item"]: r for r in result(spark, g, [(2,), (3,)], "item int").collect()}
    assert out[2]["result"] == 1 and out[2]["_error"]["node"] == "n" and out[3]["result"] == 30


def test_retry_isolation_and_short_circuit(spark):
    schema = StateSchema({"k": Field("int"), "v": Field("string", "none")})
    kind = F.when(F.col("k") == 9, "provider_authentication").otherwise("provider_unavailable")

    def flaky(s):
        return {"v": F.concat(F.lit("try "), s["_attempt"].cast("string")), "!": Fail(s["_attempt"] < s["k"], "busy", kind)}

    rows = [(0,), (1,), (2,), (3,), (9,)]
    out = {r["k"]: (r["v"], r["_error"] and r["_error"]["category"]) for r in result(spark, one(schema, flaky, retry(3)), rows, "k int").collect()}
    assert out == {0: ("try 0", None), 1: ("try 1", None), 2: ("try 2", None), 3: ("none", "provider_unavailable"), 9: ("none", "provider_authentication")}
    both = one(schema, flaky, isolate(lambda s: {"v": F.concat(F.lit("degraded "), s["k"].cast("string"))}, catch=("provider_unavailable",)), retry(3))
    out = {r["k"]: (r["v"], r["_error"] is None) for r in result(spark, both, rows, "k int").collect()}
    assert out[3] == ("degraded 3", True) and out[9] == ("none", False) and out[1] == ("try 1", True)
    skip = one(schema, lambda s: {"v": "ran", "!": Fail(s["k"] == 9)}, short_circuit(lambda s: s["k"] == 9, {"v": "skipped"}))
    assert {r["k"]: r["v"] for r in result(spark, skip, rows, "k int").collect()} == {0: "ran", 1: "ran", 2: "ran", 3: "ran", 9: "skipped"}
    with pytest.raises(ValueError):
        retry(0)


def test_instances_are_evaluated_once(spark):
    """No output, error or count of a fan-out, branch or subgraph evaluates its child again."""

    def leaf():
        child = StateSchema({"item": Field("int"), "a": Field("string"), "b": Field("string")})
        work = lambda s: {"a": F.sha1(s["item"].cast("string")), "b": "x", "!": Fail(s["item"] > 2, "big")}
        return GraphBuilder(child).add_node("w", work).add_edge("w", END).set_entry("w").compile()

    one = StateSchema({"items": Field("array<int>"), "as": Field("array<string>", []), "bs": Field("array<string>", []), "errors": Field("array<struct<fan_out_index:string,category:string>>", []), "n": Field("int", 0)})
    spec = FanOut(leaf(), "as", "a", items_field="items", item_field="item", extra_outputs={"bs": "b"}, error_policy="collect", errors_field="errors", count_field="n", on_empty="noop")
    inner = GraphBuilder(one).add_fan_out("f", spec).add_edge("f", END).set_entry("f").compile()
    two = StateSchema({"lists": Field("array<array<int>>"), "as": Field("array<array<string>>", []), "ns": Field("array<int>", [])})
    outer = FanOut(inner, "as", "as", items_field="lists", item_field="items", extra_outputs={"ns": "n"}, on_empty="noop")
    nested = GraphBuilder(two).add_fan_out("g", outer).add_edge("g", END).set_entry("g").compile()
    rows = spark.createDataFrame([(1, [1, 2, 3], [[1], [], [2, 3]])], "id int, items array<int>, lists array<array<int>>")
    for graph, schema in ((inner, one), (nested, two)):
        df = run(graph, schema.initial_state(rows, **({"items": "items"} if schema is one else {"lists": "lists"})))
        assert df._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 1
        assert df.first()["as"] is not None
    got = run(nested, two.initial_state(rows, lists="lists")).first()
    assert got["ns"] == [1, 0, 2] and [len(x) for x in got["as"]] == [1, 0, 1]


def _nested():
    inner = StateSchema({"x": Field("int"), "log": Field("array<string>", [], R.APPEND)})
    step = lambda n, fail: lambda s: {"x": s["x"] + 1, "log": F.array(F.lit(n)), "!": Fail(fail(s), n)}
    never = lambda s: F.lit(False)
    child = GraphBuilder(inner).add_node("a", step("a", never)).add_node("b", step("b", lambda s: s["x"] % 10 == 4)).add_edge("a", "b").add_edge("b", END).set_entry("a").compile()
    return child, step, never


def test_every_node_is_saved_and_rows_resume_inside_subgraphs(spark, tmp_path):
    from flowloom.operators import checkpoints

    child, step, never = _nested()
    outer = StateSchema({"n": Field("int"), "trace": Field("array<string>", [], R.APPEND)}, version="v1")

    def graph(store, fail=True):
        sub = child if fail else GraphBuilder(child.schema).add_node("a", step("a", never)).add_node("b", step("b", never)).add_edge("a", "b").add_edge("b", END).set_entry("a").compile()
        b = GraphBuilder(outer).add_node("first", lambda s: {"n": s["n"] + 1, "trace": F.array(F.lit("first"))})
        b.add_subgraph("sub", sub, Explicit({"x": "n"}, {"n": "x", "trace": "log"})).add_node("last", lambda s: {"trace": F.array(F.lit("last"))})
        b.add_edge("first", "sub").add_edge("sub", "last").add_edge("last", END).set_entry("first")
        return (b.with_checkpoints(store) if store is not None else b).compile()

    store = checkpoints.CheckpointStore(spark, str(tmp_path / "store"))
    df = outer.initial_state(spark.createDataFrame([(i,) for i in range(6)], "id int"), n="id")
    out = run(graph(store), df, invocation="id")
    plain = run(graph(None), df)
    assert sorted(out.select("id", "n", "trace", "_at").collect()) == sorted(plain.select("id", "n", "trace", "_at").collect())
    nodes = {}
    for r in store.all().orderBy("seq").collect():
        nodes.setdefault(r["invocation_id"], []).append(r["node"])
    assert nodes["0"] == ["first", "sub/a", "sub/b", "sub", "last"]
    assert nodes["2"] == ["first", "sub/a"]  # 2 + 1 + 1 = 4 fails in b
    again = checkpoints.resume(graph(None, fail=False), df, store.latest(), "id").collect()
    got = {r["id"]: (r["n"], r["trace"], r["_step"]) for r in again}
    assert got[2] == (5, ["first", "a", "b", "last"], 2) and got[0] == (3, ["first", "a", "b", "last"], 0)
    # a row without a record runs whole
    fresh = outer.initial_state(spark.createDataFrame([(77,)], "id int"), n="id")
    assert checkpoints.resume(graph(None, fail=False), fresh, store.latest(), "id").first()["trace"] == ["first", "a", "b", "last"]


def test_concurrency_of_a_fan_out_may_follow_the_state(spark):
    child = StateSchema({"item": Field("int"), "out": Field("int")})
    leaf = GraphBuilder(child).add_node("w", lambda s: {"out": s["item"] * 2}).add_edge("w", END).set_entry("w").compile()
    parent = StateSchema({"items": Field("array<int>"), "k": Field("int"), "outs": Field("array<int>", [])})
    spec = FanOut(leaf, "outs", "out", items_field="items", item_field="item", concurrency=lambda s: s["k"])
    g = GraphBuilder(parent).add_fan_out("f", spec).add_edge("f", END).set_entry("f").compile()
    rows = run(g, parent.initial_state(spark.createDataFrame([(1, [1, 2], 3), (2, [1], 0)], "id int, items array<int>, k int"))).collect()
    got = {r["id"]: (r["outs"], r["_error"] and r["_error"]["fan_out_category"]) for r in rows}
    assert got == {1: ([2, 4], None), 2: ([], "fan_out_invalid_concurrency")}
