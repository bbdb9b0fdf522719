"""Cycles inside children, lineage of resumed runs, saves across store objects, progress of fan-outs."""

import pytest
from pyspark.sql import functions as F

from flowloom.errors import RunError
from flowloom.functions import reducers as R
from flowloom.operators import checkpoints as C
from flowloom.plans.graph import END, Branch, Explicit, Fail, FanOut, GraphBuilder
from flowloom.plans.program import loops, run
from flowloom.plans.schema import Field, StateSchema


def counting(limit=None):
    """Adds 1 until x reaches its goal; fails at `limit`."""
    schema = StateSchema({"x": Field("int", 0), "goal": Field("int", 3), "log": Field("array<int>", [], R.APPEND)})
    b = GraphBuilder(schema).add_node("up", lambda s: {"x": s["x"] + 1, "log": F.array(s["x"]), "!": Fail((s["x"] == limit) if limit is not None else F.lit(False), "limit")})
    b.add_conditional_edge("up", lambda s: F.when(s["x"] < s["goal"], "up").otherwise(END), ("up", END)).set_entry("up")
    return b.compile()


def test_a_subgraph_loops_inside_a_loop(spark):
    """The outer graph goes round until the sum is large enough; the inner one loops each time."""
    schema = StateSchema({"n": Field("int"), "sum": Field("int", 0), "logs": Field("array<int>", [], R.APPEND)})
    b = GraphBuilder(schema).add_subgraph("count", counting(), Explicit({"goal": "n"}, {"sum": "x", "logs": "log"})).add_node("more", lambda s: {"n": s["n"] + 1})
    b.add_edge("count", "more").add_conditional_edge("more", lambda s: F.when(s["n"] < 5, "count").otherwise(END), ("count", END)).set_entry("count")
    g = b.compile()
    assert loops(g) and g.order() is None
    got = {r["id"]: r for r in run(g, schema.initial_state(spark.createDataFrame([(1, 2), (2, 4), (3, 9)], "id int, n int")), trace=True).collect()}
    assert got[1]["logs"] == [*range(2), *range(3), *range(4)] and [n for n in got[1]["_path"] if n != "up"] == ["count", "more"] * 3
    assert (got[2]["logs"], got[3]["sum"], got[3]["_error"]) == ([0, 1, 2, 3], 9, None)


def test_instances_loop_fail_and_are_limited(spark):
    schema = StateSchema({"goals": Field("array<int>"), "xs": Field("array<int>", []), "logs": Field("array<array<int>>", [])})

    def graph(child, **options):
        spec = FanOut(child, "xs", "x", items_field="goals", item_field="goal", extra_outputs={"logs": "log"}, **options)
        return GraphBuilder(schema).add_fan_out("f", spec).add_edge("f", END).set_entry("f").compile()

    df = schema.initial_state(spark.createDataFrame([(1, [3, 1, 2]), (2, []), (3, None), (4, [7, 1]), (4, [7, 1])], "id int, goals array<int>"))
    got = sorted((r["id"], r["xs"], r["logs"], r["_error"] and r["_error"]["fan_out_category"]) for r in run(graph(counting()), df).collect())
    want = [(1, [3, 1, 2], [[0, 1, 2], [0], [0, 1]], None), (2, [], [], "fan_out_empty"), (3, [], [], "fan_out_empty"), *[(4, [7, 1], [list(range(7)), [0]], None)] * 2]
    assert got == want
    failed = {r["id"]: (r["xs"], r["_error"] and r["_error"]["message"]) for r in run(graph(counting(5), on_empty="noop"), df).collect()}
    assert failed == {1: ([3, 1, 2], None), 2: ([], None), 3: ([], None), 4: ([], "node_exception: limit")}
    kept = {r["id"]: r["xs"] for r in run(graph(counting(5), on_empty="noop", error_policy="collect"), df).collect()}
    assert kept[4] == [1] and kept[1] == [3, 1, 2]
    with pytest.raises(RunError, match="still moving"):
        run(graph(counting()), df, max_rounds=3)


def test_looping_instances_equal_unrolled_ones(spark):
    """The same child once as rows in rounds and once, unrolled, as an expression."""
    schema = StateSchema({"x": Field("int", 0), "goal": Field("int", 3), "log": Field("array<int>", [], R.APPEND)})
    flat = GraphBuilder(schema).add_node("all", lambda s: {"x": F.greatest(s["goal"], F.lit(1)), "log": F.sequence(F.lit(0), F.greatest(s["goal"], F.lit(1)) - 1)}).add_edge("all", END).set_entry("all").compile()
    outer = StateSchema({"goals": Field("array<int>"), "xs": Field("array<int>", []), "logs": Field("array<array<int>>", [])})
    rows = outer.initial_state(spark.range(30).select("id", F.transform(F.sequence(F.lit(0), F.col("id").cast("int") % 6), lambda x: (x * 7 + F.col("id").cast("int")) % 5).alias("goals")))
    out = []
    for child in (counting(), flat):
        g = GraphBuilder(outer).add_fan_out("f", FanOut(child, "xs", "x", items_field="goals", item_field="goal", extra_outputs={"logs": "log"})).add_edge("f", END).set_entry("f").compile()
        out.append(sorted(run(g, rows).select("id", "xs", "logs").collect()))
    assert out[0] == out[1]


def test_branches_loop_and_calls_stand_beside(spark):
    schema = StateSchema({"n": Field("int"), "a": Field("int"), "b": Field("int"), "c": Field("int"), "errors": Field("array<struct<branch_name:string,category:string,message:string,cause_type:string>>", [])})
    spec = {"one": Branch(counting(), inputs={"goal": "n"}, outputs={"a": "x"}), "two": Branch(counting(2), inputs={"goal": "n"}, outputs={"b": "x"}, when=lambda s: s["n"] > 1), "call": Branch(call=lambda s: {"c": s["n"] * 10})}
    g = GraphBuilder(schema).add_branches("p", spec, error_policy="collect", errors_field="errors").add_edge("p", END).set_entry("p").compile()
    got = {r["id"]: (r["a"], r["b"], r["c"], [e["branch_name"] for e in r["errors"]]) for r in run(g, schema.initial_state(spark.createDataFrame([(1, 1), (2, 2), (3, 4)], "id int, n int"))).collect()}
    assert got == {1: (1, None, 10, []), 2: (2, 2, 20, []), 3: (4, None, 40, ["two"])}


SCHEMA = StateSchema({"x": Field("int", 0), "trace": Field("array<string>", [], R.APPEND)}, version="2")


def chain(store, fails=(), add=1):
    b = GraphBuilder(SCHEMA)
    for n in "abc":
        b.add_node(n, lambda s, n=n: {"x": s["x"] + add, "trace": F.array(F.lit(n)), "!": Fail(F.lit(n in fails), n)})
    b.add_edge("a", "b").add_edge("b", "c").add_edge("c", END).set_entry("a")
    return (b.with_checkpoints(store) if store is not None else b).compile()


def start(spark, ids, x=0):
    return SCHEMA.initial_state(spark.createDataFrame([(str(i), f"c{i}") for i in ids], "id string, conv string"), x=F.lit(x))


def test_a_restarted_driver_saves_behind_what_is_there(spark, tmp_path):
    store = lambda: C.CheckpointStore(spark, str(tmp_path))
    run(chain(store(), fails="c"), start(spark, [1]), invocation="id").count()
    run(chain(store(), fails="b"), start(spark, [1, 2], x=1000), invocation="id").count()
    last = {r["invocation_id"]: (r["node"], r["seq"]) for r in store().latest().collect()}
    assert last == {"1": ("a", 3), "2": ("a", 1)}  # not b of the first run
    again = {r["id"]: r["x"] for r in C.resume(chain(None), start(spark, [1, 2]), store().latest(), "id").collect()}
    assert again == {"1": 1003, "2": 1003}


def test_resumed_runs_save_and_keep_lineage(spark, tmp_path):
    store = lambda: C.CheckpointStore(spark, str(tmp_path))
    rows = start(spark, [1])
    run(chain(store(), fails="b"), rows, invocation="id", correlation="conv").count()
    C.resume(chain(store(), fails="c"), rows, store().heads(), "id").count()
    out = C.resume(chain(store()), rows, store().heads(), "id", trace=True).collect()
    assert [(r["x"], r["trace"], r["_step"], r["_path"]) for r in out] == [(3, ["a", "b", "c"], 1, ["c"])]
    saves = sorted(store().all().collect(), key=lambda r: r["seq"])
    ids = [r["invocation_id"] for r in saves]
    assert [r["node"] for r in saves] == ["a", "b", "c"] and len(set(ids)) == 3 and ids[0] == "1" and all(i.startswith("1~") for i in ids[1:])
    assert [r["resumed_from"] for r in saves] == [None, *ids[:2]] and {r["correlation_id"] for r in saves} == {"c1"} and {r["root_id"] for r in saves} == {"1"}
    assert [[p["path"] for p in r["completed_positions"]] for r in saves] == [["a"], ["a", "b"], ["a", "b", "c"]]
    assert {(r["invocation_id"], r["completed_node_count"]) for r in store().list("c1").collect()} == set(zip(ids, (1, 2, 3), strict=True))
    assert store().list("other").count() == 0 and store().load(ids[1]).first()["node"] == "b"
    # nothing is left to do, and nothing more is saved
    done = C.resume(chain(store()), rows, store().heads(), "id").first()
    assert (done["x"], done["_step"], store().all().count()) == (3, 0, 3)


def test_deleted_invocations_may_come_back_and_compaction_keeps_the_last(spark, tmp_path):
    store = C.CheckpointStore(spark, str(tmp_path))
    assert store.latest().count() == store.all().count() == store.list().count() == 0
    run(chain(store), start(spark, [1, 2]), invocation="id").count()
    store.delete("1")
    assert {r["invocation_id"] for r in store.latest().collect()} == {"2"}
    before = {r["invocation_id"]: tuple(r) for r in store.latest().collect()}
    store.compact()
    assert {r["invocation_id"]: tuple(r) for r in store.latest().select(*store.all().columns).collect()}.keys() == before.keys() and store.all().count() == 1
    run(chain(store), start(spark, [1]), invocation="id").count()
    assert {(r["invocation_id"], r["node"]) for r in store.latest().collect()} == {("1", "c"), ("2", "c")}
    store.compact()
    assert {(r["invocation_id"], r["x"]) for r in store.latest().select("invocation_id", F.get_json_object("state", "$.x").cast("int").alias("x")).collect()} == {("1", 3), ("2", 3)}


def test_rows_resume_inside_a_looping_subgraph(spark, tmp_path):
    outer = StateSchema({"n": Field("int"), "out": Field("int"), "log": Field("array<int>", [], R.APPEND)})

    def graph(store, limit):
        b = GraphBuilder(outer).add_subgraph("loop", counting(limit), Explicit({"goal": "n"}, {"out": "x", "log": "log"})).add_edge("loop", END).set_entry("loop")
        return (b.with_checkpoints(store) if store else b).compile()

    store = C.CheckpointStore(spark, str(tmp_path))
    rows = outer.initial_state(spark.createDataFrame([("1", 2), ("2", 5)], "id string, n int"))
    run(graph(store, 3), rows, invocation="id").count()
    assert {r["invocation_id"]: r["node"] for r in store.latest().collect()} == {"1": "loop", "2": "loop/up"}
    out = {r["id"]: (r["out"], r["log"], r["_step"]) for r in C.resume(graph(None, None), rows, store.heads(), "id").collect()}
    assert out == {"1": (2, [0, 1], 0), "2": (5, [0, 1, 2, 3, 4], 2)}


def test_compacted_stores_are_sorted_and_filtered(spark, tmp_path):
    import pyarrow.parquet as pq

    store = C.CheckpointStore(spark, str(tmp_path))
    run(chain(store), start(spark, range(200)), invocation="id", correlation="conv").count()
    store.compact()
    spans = []
    for f in sorted(p for p in tmp_path.rglob("*.parquet")):
        t = pq.read_table(f, columns=["invocation_id"]).column(0).to_pylist()
        assert t == sorted(t)
        spans += [(t[0], t[-1])] if t else []
    assert all(a[1] < b[0] for a, b in zip(sorted(spans), sorted(spans)[1:], strict=False))
    plan = store.load("77")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(invocation_id,77)" in plan and store.load("77").first()["node"] == "c" and store.list("c7").count() == 1


class Breaking(C.CheckpointStore):
    def save_progress(self, instances):
        if getattr(self, "flushed", 0) == 2:
            raise InterruptedError("lost")
        self.flushed = getattr(self, "flushed", 0) + 1
        super().save_progress(instances)


def squares(store, fail=None, policy="fail_fast", twice=False):
    child = StateSchema({"x": Field("int"), "out": Field("int")})
    leaf = GraphBuilder(child).add_node("w", lambda s: {"out": s["x"] * s["x"], "!": Fail((s["x"] == fail) if fail is not None else F.lit(False), "bad")}).add_edge("w", END).set_entry("w").compile()
    schema = StateSchema({"items": Field("array<int>"), "outs": Field("array<int>", []), "errors": Field("array<struct<fan_out_index:string,category:string>>", [])})
    spec = FanOut(leaf, "outs", "out", items_field="items", item_field="x", error_policy=policy, errors_field="errors" if policy == "collect" else None, flushes=4)
    b = GraphBuilder(schema).add_fan_out("f", spec).set_entry("f")
    if twice:  # the second visit has other items
        b.add_node("next", lambda s: {"items": F.transform(s["items"], lambda x: x + 10)}).add_edge("f", "next")
        b.add_conditional_edge("next", lambda s: F.when(s["items"][0] < 20, "f").otherwise(END), ("f", END))
    else:
        b.add_edge("f", END)
    return b.with_checkpoints(store).compile(), schema


def test_a_broken_fan_out_goes_on_with_the_instances_left(spark, tmp_path):
    rows = [("1", [1, 2, 3, 4, 5, 6, 7]), ("2", [9])]
    g, schema = squares(Breaking(spark, str(tmp_path)))
    df = schema.initial_state(spark.createDataFrame(rows, "id string, items array<int>"))
    with pytest.raises(InterruptedError):
        run(g, df, invocation="id").count()
    store = C.CheckpointStore(spark, str(tmp_path))
    first = {(r["root_id"], r["fan_out_index"]): r["invocation_id"] for r in store.progress().collect()}
    assert set(first) == {("1", k) for k in (0, 1, 4, 5)} | {("2", 0)}
    g, _ = squares(store)
    out = {r["id"]: r["outs"] for r in C.resume(g, df, store.heads(), "id", run_id="again").collect()}
    assert out == {"1": [1, 4, 9, 16, 25, 36, 49], "2": [81]}
    assert store.progress().count() == 8  # every instance ran once
    # another number of instances isn't the same fan-out
    other = schema.initial_state(spark.createDataFrame([("1", [1, 2])], "id string, items array<int>"))
    (bad,) = run(g, other, invocation="id").collect()
    assert bad["_error"]["category"] == "node_exception" and "checkpoint_record_invalid" in bad["_error"]["message"]


def test_failed_instances_run_again_or_are_kept_by_policy(spark, tmp_path):
    df = spark.createDataFrame([("1", [1, 2, 3])], "id string, items array<int>")
    for policy in ("fail_fast", "collect"):
        store = C.CheckpointStore(spark, str(tmp_path / policy))
        g, schema = squares(store, fail=2, policy=policy)
        first = run(g, schema.initial_state(df), invocation="id").first()
        assert sorted((r["fan_out_index"], r["result_is_error"]) for r in store.progress().collect()) == ([(0, False), (2, False)] if policy == "fail_fast" else [(0, False), (1, True), (2, False)])
        assert (first["_error"] is None) == (policy == "collect")
        g, _ = squares(store, policy=policy)
        if policy == "fail_fast":
            assert C.resume(g, schema.initial_state(df), store.heads(), "id").first()["outs"] == [1, 4, 9]
        else:
            assert first["outs"] == [1, 9] and [e["fan_out_index"] for e in first["errors"]] == ["1"]


def test_each_visit_of_a_fan_out_has_its_own_progress(spark, tmp_path):
    store = C.CheckpointStore(spark, str(tmp_path))
    g, schema = squares(store, twice=True)
    df = schema.initial_state(spark.createDataFrame([("1", [1, 2])], "id string, items array<int>"))
    assert run(g, df, invocation="id").first()["outs"] == [121, 144]
    assert sorted((r["visit"], r["fan_out_index"]) for r in store.progress().collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_progress_meets_rows_not_instances(spark, tmp_path):
    """What is saved is joined with rows before they are exploded, and a first run joins nothing."""
    plans = []

    class Seen(C.CheckpointStore):
        def save_progress(self, instances):
            plans.append(instances._jdf.queryExecution().optimizedPlan().toString())
            super().save_progress(instances)

    rows = [(str(k), list(range(k % 5))) for k in range(12)]
    df = spark.createDataFrame(rows, "id string, items array<int>")
    g, schema = squares(Breaking(spark, str(tmp_path)))
    with pytest.raises(InterruptedError):
        run(g, schema.initial_state(df), invocation="id").count()
    before = {(r["root_id"], r["fan_out_index"]) for r in C.CheckpointStore(spark, str(tmp_path)).progress().collect()}
    # a place that was saved twice counts once
    C.CheckpointStore(spark, str(tmp_path)).save_progress(C.CheckpointStore(spark, str(tmp_path)).progress().where("root_id = '4'").persist())
    g, _ = squares(Seen(spark, str(tmp_path)))
    out = {r["id"]: r["outs"] for r in C.resume(g, schema.initial_state(df), C.CheckpointStore(spark, str(tmp_path)).heads(), "id", run_id="r").collect()}
    assert out == {k: [x * x for x in items] for k, items in rows}
    later = {(r["root_id"], r["fan_out_index"]) for r in C.CheckpointStore(spark, str(tmp_path)).progress().where("invocation_id like '%~r' or root_id = invocation_id").collect()}
    assert before < later and len(plans) == 4 and not any("Join" in p for p in plans)
    # a resumed run's numbers go on above its own earlier ones, also where a name looks like one of another's
    names = spark.createDataFrame([("1",), ("1~r",), ("2",)], "id string")
    top = C.CheckpointStore(spark, str(tmp_path / "top"))
    top.save(spark.createDataFrame([("1", "1", 3), ("1~r", "1", 7), ("2", "2", 5)], "invocation_id string, root_id string, seq long"))
    who = lambda name, root: F.struct(name.alias("invocation"), root.alias("root"), F.lit(1).cast("long").alias("base"))
    got = {r["id"]: r["_run"]["base"] for r in top.above(names.withColumn("_run", who(F.col("id"), F.col("id"))), F.col("id"), "r").collect()}
    assert got == {"1": 3, "1~r": 7, "2": 5}
    got = {r["id"]: r["_run"]["base"] for r in top.above(names.withColumn("_run", who(F.concat("id", F.lit("~r")), F.col("id"))), F.col("id"), "r").collect()}
    assert got == {"1": 7, "1~r": 1, "2": 1}
