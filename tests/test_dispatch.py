"""Templates that differ by row, what counts as true, scratch tables that go, best items of stated queries."""

import os

import pytest
from pyspark.sql import functions as F

from flowloom.errors import PromptError
from flowloom.functions import prompts as P
from flowloom.functions.templates import Dispatcher, rendered_template
from flowloom.operators.ranking import best_of
from flowloom.sources.scratch import Scratch


def test_rows_have_templates_of_their_own(spark):
    rows = [
        (1, "{% if n > 1 %}many{% else %}one{% endif %}"), (2, "{{ who }} and {{who}}"), (3, "{{ who|upper }}"), (4, "{{ lost }}"), (5, "{{ lost|upper }}"), (6, "{% if n %}"), (7, "no names"), (8, None),
        (9, "{# note #}{{ n + 1 }}"), (10, "a {{- who -}} b"), (11, ""),
    ]
    df = spark.createDataFrame([(i, t, i % 3, "Ann") for i, t in rows], "i int, t string, n int, who string")
    by = Dispatcher.of(df, F.col("t"), {"n": F.col("n"), "who": F.col("who")})
    got = {r["i"]: (r["text"], r["error"]) for r in df.select("i", by.text(F.col("t")).alias("text"), by.error(F.col("t")).alias("error")).collect()}
    assert {i: t for i, (t, e) in got.items() if e is None} == {1: "one", 2: "Ann and Ann", 3: "ANN", 7: "no names", 9: "1", 10: "aAnnb", 11: ""}
    assert (got[4][1], got[5][1], got[8][1]) == ("lost is not defined",) * 2 + ("no template",) and got[6][0] is None and "missing" in got[6][1]
    assert len(by.texts) == 4 and len(by.errors) == 2  # plain templates aren't compiled one by one
    with pytest.raises(PromptError):
        Dispatcher.of(df, F.col("t"), {}, most=2)


def test_chat_segments_are_dispatched(spark):
    segments = F.array(*(F.struct(F.lit(r).alias("role"), t.alias("template"), F.lit(p).cast("string").alias("placeholder")) for r, t, p in (("system", F.col("a"), None), ("user", F.lit(None).cast("string"), "h"), ("user", F.col("b"), None))))
    df = spark.createDataFrame([(1, "{% if x %}X{% else %}-{% endif %}", "hi {{ name }}", True), (2, "plain", "{{ name|lower }}!", False)], "i int, a string, b string, x boolean")
    scope = {"x": F.col("x"), "name": F.lit("Bo")}
    by = Dispatcher.of(df.select("*", F.explode(F.array("a", "b")).alias("t")), F.col("t"), scope)
    injected = F.create_map(F.lit("h"), F.array(F.struct(F.lit("user").alias("role"), F.lit("before").alias("content"))))
    out = {r["i"]: [tuple(m) for m in r["m"]] for r in df.select("i", P.chat(segments, F.create_map(), injected, by.text).alias("m")).collect()}
    assert out == {1: [("system", "X"), ("user", "before"), ("user", "hi Bo")], 2: [("system", "plain"), ("user", "before"), ("user", "bo!")]}


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("'0'", True), ("'false'", True), ("'[]'", True), ("''", False), ("cast(null as string)", False), ("true", True), ("false", False), ("0", False), ("-0.0D", False), ("cast(0 as decimal(9,2))", False),
        ("cast(0.01 as decimal(9,2))", True), ("2.5D", True), ("array()", False), ("array('')", True), ("map()", False), ("map('k', 0)", True), ("named_struct('a', null)", True), ("date'2024-01-01'", True), ("null", False),
        ("double('NaN')", True),
    ],
)
def test_truth_goes_by_type(spark, value, want):
    df = spark.range(1).select(F.expr(value).alias("v"))
    assert df.select(rendered_template("{% if v %}t{% else %}f{% endif %}", v=F.col("v"))).first()[0] == ("t" if want else "f")


def test_scratch_tables_can_be_dropped(spark):
    s = Scratch(spark, "gone")
    table, n = s.counted(spark.range(10), F.col("id") > 3)
    path = s.root.removeprefix("file:")
    assert n == 6 and table.count() == 10 and os.path.isdir(path)
    s.drop("0001")
    assert not os.path.isdir(f"{path}/0001") and os.path.isdir(path)
    s._end()
    assert not os.path.isdir(path)


def test_best_of_is_the_same_in_blocks(spark):
    items = spark.range(200).select(F.col("id").alias("doc"), (F.col("id") * 7 % 31).alias("x"))
    queries = spark.range(9).select(F.col("id").alias("q"))
    whole = [best_of(items, queries, (F.col("x") * (F.col("q") + 1)) % 13, "q", "doc", 4, **o).orderBy("q", "rank").collect() for o in ({}, {"max_queries": 2}, {"block_bytes": 100})]
    assert whole[0] == whole[1] == whole[2] and len(whole[0]) == 36
    assert best_of(items, queries.where("false"), F.col("x"), "q", "doc", 4).count() == 0


def test_trace_payloads_fall_back_and_are_bounded(spark):
    from flowloom.functions.telemetry import trace_io

    df = spark.createDataFrame([("a", None, "hook"), ("b", "c2", None)], "node string, corr string, said string")
    stub, state = {"entry_node": F.col("node"), "correlation_id": F.col("corr")}, {"x": F.lit("é" * 200)}
    got = df.select(trace_io(stub, state), trace_io(stub, state, F.col("said")), trace_io(stub, state, F.col("said"), shown=True, limit=256), trace_io(stub, state, F.col("said"), shown=True, isolated=False)).collect()
    assert tuple(got[0])[:2] == ('{"entry_node":"a"}', "hook") and got[0][2] == "hook" and got[0][3] == got[0][0]
    least = '{"correlation_id":"c2","entry_node":"b"}'
    assert (got[1][0], got[1][1], got[1][3]) == (least, least, least) and len(got[1][2].encode()) <= 256 and "truncated" in got[1][2]
