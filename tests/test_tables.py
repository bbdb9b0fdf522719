"""Checkpoint stores, event tables, prompts from files, streams and text expressions."""

import json

import pytest
from pyspark.sql import functions as F

from flowloom.errors import CheckpointError
from flowloom.functions import messages as M
from flowloom.functions import prompts as P
from flowloom.functions import retrieval as V
from flowloom.functions import telemetry as T
from flowloom.operators import checkpoints as C
from flowloom.operators import events as E
from flowloom.operators.ranking import nearest, result_error
from flowloom.plans.graph import Migration, Migrations
from flowloom.queries import QUERIES
from flowloom.sources.prompts import sidecars, templates
from flowloom.streaming.delivery import deliver, event_stream, windowed_counts


def test_checkpoint_store(spark, tmp_path):
    store = C.CheckpointStore(spark, str(tmp_path / "saves"))
    kind = "invocation_id string, seq long, correlation_id string, last_saved_at double, completed_positions array<string>"
    store.save(spark.createDataFrame([("a", 1, "c1", 1.0, ["x"]), ("b", 1, "c2", 2.0, [])], kind))
    store.save(spark.createDataFrame([("a", 2, "c1", 3.0, ["x", "y"])], kind))
    assert [(r["seq"], r["last_saved_at"]) for r in store.load("a").collect()] == [(2, 3.0)] and store.load("zz").count() == 0
    assert {(r["invocation_id"], r["completed_node_count"]) for r in store.list().collect()} == {("a", 2), ("b", 0)}
    assert [r["invocation_id"] for r in store.list("c2").collect()] == ["b"]
    store.delete("a")
    store.delete("never there")
    assert {r["invocation_id"] for r in store.latest().collect()} == {"b"}


def test_migration_of_mixed_versions(spark):
    df = spark.createDataFrame([(1, "1", 5), (2, "2", 6), (3, "", 7)], "id int, schema_version string, n int")
    steps = Migrations([Migration("", "1", lambda s: {"n": s["n"] * 10}), Migration("1", "2", lambda s: {"tag": F.lit("new")})])
    out = C.migrated(df, steps, "2", {"n": "int", "tag": "string"}).orderBy("id").collect()
    assert [(r["n"], r["tag"], r["schema_version"]) for r in out] == [(5, "new", "2"), (6, None, "2"), (70, "new", "2")]
    with pytest.raises(CheckpointError, match="missing"):
        C.migrated(df, steps, "9", {"n": "int"})
    broken = Migrations([Migration("1", "2", lambda s: s["no such field"]), Migration("", "2", lambda s: {})])
    with pytest.raises(CheckpointError, match="failed"):
        C.migrated(df, broken, "2", {"n": "int"})


def test_migration_of_many_versions(spark):
    df = spark.range(1200).selectExpr("id", "cast(id as string) as schema_version", "0 as n")
    steps = Migrations([Migration(str(i), "now", lambda s: {"n": s["n"] + 1}) for i in range(1200)])
    assert {r["n"] for r in C.migrated(df, steps, "now", {"n": "int"}).collect()} == {1}
    with pytest.raises(CheckpointError, match="missing"):
        C.migrated(df.union(spark.createDataFrame([(1200, "other", 0)], df.schema)), steps, "now", {"n": "int"})


def test_spans_below_many_detached_nodes(spark, tmp_path):
    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.range(150).selectExpr("id as n_nationkey", "concat('N1-', id) as n_name", "0 as n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(150).selectExpr("id as s_suppkey", "id as s_nationkey", "concat('S', id) as s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["span"]: r["trace"] for r in QUERIES["span_detached"](spark, str(tmp_path)).collect()}
    assert got == {f"R/N1-{i}/S{i}": f"run/R/N1-{i}" for i in range(150)}


def test_phases(spark):
    df = spark.createDataFrame([("node", "started"), ("node", "checkpoint_saved"), ("llm", None)], "kind string, phase string")
    assert E.subscribed(df).count() == 2 and E.subscribed(df, ("checkpoint_saved",)).count() == 2
    for bad in ((), ("nope",)):
        with pytest.raises(ValueError):
            E.subscribed(df, bad)


def test_prefixes_and_truncation(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"]), (["a", "b"], ["a"]), ([], ["a"]), (["a"], ["a"])], "p array<string>, w array<string>")
    got = df.select(T.is_prefix(F.col("p"), F.col("w")), T.is_prefix(F.col("p"), F.col("w"), strict=True)).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (True, True), (True, False)]
    texts = ["a" * 256, "a" * 257] + [("x" * k) + "é日😀" * 60 for k in range(8)]
    cut = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.truncated(F.col("t"), 256)).collect()]
    for t, c in zip(texts, cut, strict=True):
        raw = t.encode()
        if len(raw) <= 256:
            assert c == t
        else:
            marker = f"…[truncated, {len(raw)} bytes total]"
            room = 256 - len(marker.encode())
            assert c == raw[:room].decode("utf-8", "ignore") + marker
    with pytest.raises(ValueError):
        T.truncated(F.col("t"), 10)


def test_ids_budgets_and_chains(spark):
    u = "6F9619FF-8B86-D011-B42D-00CF4FC964FF"
    r = spark.range(1).select(T.trace_id(F.lit(u)), T.valid_invocation_id(F.lit("a.b~c")), T.valid_invocation_id(F.lit("a b"))).first()
    assert tuple(r) == (u.replace("-", "").lower(), True, False)
    null = F.lit(None).cast("long")
    b = spark.range(1).select(T.token_budget(F.lit(5), null, null, F.lit(0), F.lit(3)).alias("b")).first()["b"]
    assert [(x["kind"], x["exceeded"], x["ratio"]) for x in b] == [("input", True, None)]
    m = F.create_map(F.lit("gen_ai.x"), F.lit(1), F.lit("fine"), F.lit(2))
    assert spark.range(1).select(T.metadata_error(m)).first()[0] == "gen_ai.x"


def test_prompt_files(spark, tmp_path):
    (tmp_path / "production").mkdir()
    (tmp_path / "production" / "greet.j2").write_text("Hi {{ name }}")
    (tmp_path / "flat.j2").write_text("plain")
    (tmp_path / "production" / "greet.json").write_text(json.dumps({"temperature": 0.1, "extras": {"top_p": 0.5}}))
    got = {(r["label"], r["name"]): r for r in templates(spark, str(tmp_path)).collect()}
    assert got["production", "greet"]["template"] == "Hi {{ name }}" and (None, "flat") in got
    assert got[None, "flat"]["template_hash"].startswith("sha256:") and len(got[None, "flat"]["version"]) == 16
    s = sidecars(spark, str(tmp_path)).select(P.sidecar(F.col("config")).alias("s")).first()["s"]
    assert (s["temperature"], s["top_p"], s["seed"]) == (0.1, 0.5, None)


def test_rendering(spark):
    v = F.create_map(F.lit("a"), F.lit("1 {{ b }}"), F.lit("b"), F.lit("2"))
    df = spark.createDataFrame([("{{a}}-{{ b }}{{b}}",), ("no variables",), ("{{ c }} {{ a }}",), ("",)], "t string")
    got = [tuple(r) for r in df.select(P.rendered(F.col("t"), v), P.undefined(F.col("t"), v)).collect()]
    assert got == [("1 {{ b }}-22", []), ("no variables", []), ("{{ c }} 1 {{ b }}", ["c"]), ("", [])]


def test_wire_parsers(spark):
    df = spark.createDataFrame([("5",), ('"5"',), ("5.0",), ("-1",), ("true",), ("99999999999999999999",), (None,)], "t string")
    assert [r[0] for r in df.select(V.counter(F.col("t"))).collect()] == [5, None, None, None, None, None, None]
    df = spark.createDataFrame([("AACAPwAAAEA=",), ("AAA=",), ("",), ("!!",), (None,)], "t string")
    assert [r[0] for r in df.select(V.decoded_vector(F.col("t"))).collect()] == [[1.0, 2.0], None, None, None, None]
    statuses = spark.createDataFrame([(s,) for s in (401, 413, 422, 404, 429, 500, 302)], "s int")
    tei = [r[0] for r in statuses.select(V.http_category(F.col("s"), "tei")).collect()]
    assert tei == ["provider_authentication", "provider_invalid_request", "provider_invalid_request", "provider_invalid_model", "provider_rate_limit", "provider_unavailable", "provider_unavailable"]
    assert statuses.select(V.http_category(F.col("s"), "cohere")).collect()[1][0] == "provider_unavailable"


def test_cosine_of_zero_vectors_and_query_bound(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "vec_id int, embedding array<float>")
    got = {r["vec_id"]: r["score"] for r in nearest(df, df.where("vec_id = 1"), 3).collect()}
    assert got[1] == 1.0 and got[2] == 0.0 and abs(got[3] - 0.5**0.5) < 1e-12
    # more queries than a block takes go through in blocks
    whole = sorted(tuple(r) for r in nearest(df, df, 2).collect())
    assert len(whole) == 6 and sorted(tuple(r) for r in nearest(df, df, 2, max_queries=1).collect()) == whole
    assert sorted(tuple(r) for r in nearest(df, df, 2, block_bytes=40).collect()) == whole


def test_nearest_makes_no_row_a_pair_and_scores_like_sql(spark):
    import duckdb
    import numpy as np

    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.normal(size=16).astype("f4")]) for k in range(400)]
    rows += [(k + 400, rows[k % 3][1]) for k in range(60)]  # copies tie
    rows += [(460, [0.0] * 16), (461, None), (462, [1.0, None] * 8), (463, [1.0] * 5), (464, []), (465, [float("nan")] * 16), (466, [float("inf")] + [1.0] * 15), (467, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = nearest(df, df.where("vec_id % 20 = 0 or vec_id > 455"), 12)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan and "lambda" not in plan
    # as the expression has it row by row, odd vectors included
    one, other = (df.select(F.col("vec_id").alias(n + "_id"), F.col("embedding").alias(n)) for n in ("a", "b"))
    every = one.crossJoin(other.where("b_id % 20 = 0 or b_id > 455")).select("b_id", "a_id", V.cosine(F.col("a"), F.col("b")).alias("s")).collect()
    key = lambda s: (2.0 if s != s else -2.0 if s is None else round(s, 12))
    want = {q: sorted(((-key(s), v) for b, v, s in every if b == q))[:12] for q in {x[0] for x in every}}
    got = {}
    for x in found.orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((-key(x["score"]), x["vec_id"]))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}
    # and to the last bit as the SQL has it
    plain = {k: v for k, v in rows[:400]}
    for x in found.where("query_id < 400 and vec_id < 400").limit(200).collect():
        sql = duckdb.execute("SELECT list_cosine_similarity(CAST(? AS DOUBLE[]), CAST(? AS DOUBLE[]))", [plain[x["query_id"]], plain[x["vec_id"]]]).fetchone()[0]
        assert x["score"] == sql


def test_rerank_errors(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 0), ("c", 9), ("d", 0), ("d", 1), ("d", 2)], "q string, i int")
    assert {r["q"]: r["error"] for r in result_error(df, "q", "i", F.lit(3), 2).collect()} == {"a": None, "b": "index_repeated", "c": "index_range", "d": "too_many"}


def test_tool_references_need_an_earlier_call(spark):
    rows = [("c", 1, "assistant", ["t1"], None), ("c", 2, "tool", None, "t1"), ("c", 3, "tool", None, "t2"), ("c", 4, "assistant", ["t2"], None), ("d", 1, "tool", None, "t1")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, tool_call_ids array<string>, tool_call_id string")
    assert {(r["conv_id"], r["turn"]) for r in M.unmatched_tool_messages(df).collect()} == {("c", 3), ("d", 1)}


def test_message_and_block_rules(spark):
    df = spark.createDataFrame([("system", ""), ("assistant", ""), ("assistant", "x"), ("robot", "x"), ("tool", "")], "role string, text string")
    assert [r[0] for r in df.select(M.message_error(F.col("role"), F.col("text"))).collect()] == ["content_empty", "assistant_empty", None, "role", None]
    blocks = spark.createDataFrame([([("text", "hi", None), ("image", None, "QUJD")],)], "b array<struct<type:string,text:string,data:string>>")
    assert [tuple(x) for x in blocks.select(M.redacted_blocks(F.col("b"))).first()[0]] == [("text", "hi", None), ("inline_redacted", None, 4)]


def test_stream_delivery_isolates_sinks(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.createDataFrame([(k, "node", "started" if k % 2 else "completed") for k in range(10)], "id int, kind string, phase string").write.parquet(src)
    got: list[int] = []

    def bad(batch, number):
        raise RuntimeError("sink")

    q = deliver(event_stream(spark, src, "id int, kind string, phase string"), {"bad": bad, "good": lambda b, n: got.extend(r["id"] for r in b.collect())}, str(tmp_path / "cp"), phases=("started",), node_events=True)
    q.awaitTermination(60)
    assert sorted(got) == [1, 3, 5, 7, 9] and q.sink_failures[0][1] == "bad"


def test_windowed_counts(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) as ts, 'a' as kind from range(180)").write.parquet(src)
    s = windowed_counts(event_stream(spark, src, "ts timestamp, kind string"), "ts", "10 seconds", "1 minute", "kind")
    q = s.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["n"] for r in spark.table("windows").orderBy("start").collect()] == [60, 60, 60]


def test_attempts_stop_at_permanent_failures(spark):
    from flowloom.operators.attempts import isolated, outcome

    rows = [("a", 0, "busy"), ("a", 1, "ok"), ("b", 0, "denied"), ("b", 1, "ok"), ("c", 0, "busy"), ("c", 1, "busy"), ("c", 2, "busy"), ("c", 3, "ok"), ("d", 0, "busy")]
    df = spark.createDataFrame(rows, "k string, n int, s string")
    got = {r["k"]: (r["attempt"], r["succeeded"]) for r in outcome(df, "k", "n", F.col("s") != "ok", F.col("s") == "busy").collect()}
    assert got == {"a": (1, True), "b": (0, False), "c": (2, False), "d": (0, False)}
    assert isolated(df, F.col("s") == "denied", {"s": F.lit("degraded")}).where("isolated").first()["s"] == "degraded"


def test_sinks_come_and_go_and_lost_batches_are_kept(spark, tmp_path):
    from flowloom.streaming.delivery import Sinks, drain

    src = str(tmp_path / "events")
    spark.createDataFrame([(k,) for k in range(6)], "id int").write.parquet(src)
    seen: list[int] = []

    def bad(batch, number):
        raise RuntimeError("sink")

    sinks = Sinks({"bad": bad})
    gone = sinks.attach("gone", lambda b, n: seen.append(-1))
    sinks.attach("good", lambda b, n: seen.append(b.count()))
    gone()
    gone()
    q = deliver(event_stream(spark, src, "id int"), sinks, str(tmp_path / "cp"), dead_letters=str(tmp_path / "dead"))
    assert drain(q, 8, 60) == {"undelivered": 2, "timed_out": False}
    assert sum(seen) == 6 and spark.read.parquet(str(tmp_path / "dead")).where("sink = 'bad'").count() == 6


@pytest.mark.parametrize(
    ("template", "want"),
    [
        ("{{ a }}-{{ n + 1 }}", "x-3"), ("{% if n > 1 and not flag %}yes{% else %}no{% endif %}", "yes"), ("{% for x in xs %}{{ loop.index0 }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", "0p,1q"),
        ("{% for x in none_ %}{{ x }}{% else %}nothing{% endfor %}", "nothing"), ("{{ a|upper|replace('X', 'y') }}", "y"), ("{{ m.k }}{{ m['k'] }}", "vv"), ("{{ xs[1] }}{{ xs|join('+') }}", "qp+q"),
        ("a {%- if flag -%} b {%- endif -%} c", "ac"), ("{# note #}{{ missing_|default('d') }}{{ missing_ }}", "d"), ("{% if a == 'x' or n == 9 %}{{ 'q' in xs }}{% endif %}", "true"),
        ("{% for x in xs %}{% for y in xs %}{{ x ~ y }} {% endfor %}{% endfor %}", "pp pq qp qq "), ("{{ (n + 1) * 2 }} {{ 7 / 2 }}", "6 3.5"), ("plain", "plain"), ("", ""),
    ],
)
def test_template_language(spark, template, want):
    from flowloom.functions.templates import rendered_template

    none = F.lit(None).cast("array<string>")
    scope = {
        "a": F.lit("x"), "n": F.lit(2), "flag": F.lit(False), "xs": F.array(F.lit("p"), F.lit("q")), "none_": none, "m": F.create_map(F.lit("k"), F.lit("v")), "missing_": F.lit(None).cast("string"),
    }
    assert spark.range(1).select(rendered_template(template, **scope).alias("t")).first()["t"] == want


@pytest.mark.parametrize("template", ["{{ nope }}", "{% if a %}", "{% for x %}{% endfor %}", "{{ a|nope }}", "{{ a + }}", "{% include 'x' %}", "{{ (a }}"])
def test_templates_that_are_refused(template):
    from flowloom.errors import PromptError
    from flowloom.functions.templates import rendered_template

    with pytest.raises(PromptError):
        rendered_template(template, a=F.lit("x"))


def test_providers_fail_by_request(spark):
    from flowloom.errors import ProviderError
    from flowloom.operators.providers import embedded, reranked

    def embed(texts):
        if "bad" in texts:
            raise ProviderError("provider_rate_limit", "busy")
        return [(i, [1.0]) for i in range(len(texts))] if "odd" not in texts else [(0, [1.0])] * 2

    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "bad"), (3, "c"), (4, "odd"), (5, "d"), (6, None)], "id int, t string").coalesce(1)
    got = {r["id"]: (r["vector"], r["category"]) for r in embedded(rows, embed, "id", "t", 2, attempts=2).collect()}
    assert got[0] == got[1] == ([1.0], None) and got[2] == got[3] == (None, "provider_rate_limit")
    assert got[4] == (None, "provider_invalid_response") and got[6] == (None, "provider_invalid_request")

    def rank(query, documents):
        return [(k, float(len(x))) for k, x in enumerate(documents)] if query == "q" else [(0, 1.0), (0, 2.0)]

    lists = spark.createDataFrame([(1, "q", ["aa", "b", "cc", "dddd"]), (2, "r", ["a"]), (3, "q", []), (4, None, ["a"])], "id int, q string, docs array<string>")
    out = sorted((r["id"], r["rank"] or 0, r["index"], r["category"]) for r in reranked(lists, rank, "id", "q", "docs", 3, 3).collect())
    assert out == [(1, 1, 3, None), (1, 2, 0, None), (1, 3, 2, None), (2, 0, None, "provider_invalid_response"), (3, 0, None, "provider_invalid_request"), (4, 0, None, "provider_invalid_request")]
