"""Embedding and reranking calls of many inputs, their usage, events and token metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..errors import ProviderError
from ..operators import calls as C
from ..operators.events import histogram
from ..session import table
from .registry import query


def stub_embed(texts):
    """Vectors of the texts' lengths, last input first; a request with a text of 13 characters reports no usage."""
    entries = [(i, (float(len(t)), float(i))) for i, t in enumerate(texts)][::-1]
    return {"entries": entries, "tokens": None if any(len(t) == 13 for t in texts) else sum(map(len, texts)), "id": f"r{len(texts)}", "model": "stub"}


def stub_rerank(asked, documents):
    """Scores by length; a query of 7 ends is refused."""
    if asked.endswith("7"):
        raise ProviderError("provider_invalid_model", "no such model")
    return {"entries": [(i, float(len(d) % 17)) for i, d in enumerate(documents)], "tokens": len(asked) + sum(map(len, documents)), "id": "r", "model": "stub"}


def _inputs(spark, d):
    """Part names as inputs of one call a brand; the place is the name's number in its brand."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand")
    return p.withColumn("place", (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).cast("long"))


_PART = """WITH p AS (SELECT p_brand, p_partkey, p_name, length(p_name) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place FROM part),
r AS (SELECT p_brand, place // 8 AS request, count(*) AS k, sum(n) AS s, count_if(n = 13) AS silent FROM p GROUP BY 1, 2),
c AS (SELECT p_brand AS "call", CAST(sum(k) AS BIGINT) AS inputs, count(*) AS requests, CAST(CASE WHEN sum(silent) = 0 THEN sum(s) END AS BIGINT) AS tokens, 'r' || CAST(arg_min(k, request) AS VARCHAR) AS response_id FROM r GROUP BY 1)
"""


@query(_PART + """SELECT "call", inputs, requests, tokens, response_id FROM c""")
def embed_call_usage(spark, d):
    """A row a call: usage is the sum of its requests only if each reported it."""
    _, calls = C.embed_calls(_inputs(spark, d), stub_embed, "p_brand", "place", "p_name", 8)
    return calls.select("call", "inputs", "requests", "tokens", "response_id")


@query(_PART + """SELECT p_brand AS "call", place, n::DOUBLE AS size, (place % 8)::DOUBLE AS local FROM p""")
def embed_call_vectors(spark, d):
    """Vectors of all inputs, each at its place in the call, whatever the order of the responses."""
    vectors, _ = C.embed_calls(_inputs(spark, d), stub_embed, "p_brand", "place", "p_name", 8)
    return vectors.select("call", "place", F.get("vector", F.lit(0)).alias("size"), F.get("vector", F.lit(1)).alias("local"))


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_comment_n AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM (SELECT o_custkey, o_orderkey, length(CAST(o_totalprice AS VARCHAR)) + o_orderkey % 20 AS o_comment_n FROM orders)),
s AS (SELECT *, CAST(n % 17 AS DOUBLE) AS score FROM x WHERE o_custkey % 10 <> 7)
SELECT CAST(o_custkey AS VARCHAR) AS "call", place, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, place) AS rank FROM s) WHERE rank <= 3""")
def rerank_call_topk(spark, d):
    """A customer's orders ranked in requests of 4 and cut to 3 over the whole call; refused calls have no rows."""
    size = F.char_length(F.col("o_totalprice").cast("string")) + F.col("o_orderkey") % 20
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice").withColumn("text", F.repeat(F.lit("x"), size.cast("int")))
    o = o.withColumns({"place": (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long"), "asked": F.concat(F.lit("q"), F.col("o_custkey").cast("string"))})
    ranked, _ = C.rerank_calls(o, stub_rerank, "o_custkey", "asked", "place", "text", 4, 3)
    return ranked.select("call", "place", "score", F.col("rank").cast("long").alias("rank"))


@query(_PART + """, h AS (SELECT CASE WHEN tokens <= 100 THEN 100 WHEN tokens <= 400 THEN 400 WHEN tokens <= 1600 THEN 1600 ELSE 999999 END AS edge, tokens FROM c WHERE tokens IS NOT NULL)
SELECT edge, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS total FROM h GROUP BY 1""")
def metric_input_tokens(spark, d):
    """Input tokens of embedding calls as a histogram; calls without usage are left out, not counted as 0."""
    _, calls = C.embed_calls(_inputs(spark, d), stub_embed, "p_brand", "place", "p_name", 8)
    bounds = [100.0, 400.0, 1600.0]
    h = histogram(calls, F.col("tokens").cast("double"), bounds)
    return h.select(F.element_at(F.array(*(F.lit(int(b)) for b in bounds), F.lit(999_999)), F.col("bucket").cast("int") + 1).alias("edge"), "n", F.col("total").cast("bigint").alias("total"))


@query(_PART + """SELECT "call" AS invocation_id, 'embedding' AS kind, '{"input_tokens":' || coalesce(CAST(tokens AS VARCHAR), 'null') || ',"inputs":' || CAST(inputs AS VARCHAR) || ',"model":"stub","requests":' || CAST(requests AS VARCHAR) || '}' AS attributes FROM c""")
def embed_call_events(spark, d):
    """One event a call, however many requests it took."""
    _, calls = C.embed_calls(_inputs(spark, d), stub_embed, "p_brand", "place", "p_name", 8)
    return C.provider_events(calls.withColumn("at", F.lit(None).cast("timestamp")), "embedding", "at").select("invocation_id", "kind", "attributes")
