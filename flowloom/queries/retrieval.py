"""Embedding and rerank calls over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import retrieval as V
from ..operators import ranking as K
from ..session import table
from .registry import query


@query("SELECT label, count(*) AS n_vectors, min(len(embedding)) AS n_min, max(len(embedding)) AS n_max, count(DISTINCT len(embedding)) = 1 AND count(embedding) = count(*) AS valid FROM embeddings GROUP BY label")
def embed_validate(spark, d):
    n = F.size("embedding")
    g = table(spark, d, "embeddings", "label", "embedding").groupBy("label").agg(
        F.count("*").alias("n_vectors"), F.min(n).cast("long").alias("n_min"), F.max(n).cast("long").alias("n_max"), ((F.countDistinct(n) == 1) & (F.count("embedding") == F.count("*"))).alias("valid")
    )
    return g


@query("""WITH c AS (SELECT doc_id, n_chars, CAST(floor(doc_id / 96) AS BIGINT) AS chunk FROM documents)
SELECT chunk, count(*) AS n_inputs, CASE WHEN count(CASE WHEN n_chars % 7 <> 0 THEN 1 END) = count(*) THEN CAST(sum(n_chars) AS VARCHAR) END AS tokens, min(doc_id) AS first_id FROM c GROUP BY chunk""")
def embed_chunk_stitch(spark, d):
    """Consecutive chunks of 96 inputs; usage only where every input reports it."""
    t = table(spark, d, "documents", "doc_id", "n_chars")
    tokens = F.when(F.col("n_chars") % 7 != 0, F.col("n_chars"))
    c = t.select(F.floor(F.col("doc_id") / V.REQUEST_CAPS["cohere"]).alias("chunk"), "doc_id", tokens.alias("tokens"))
    return c.groupBy("chunk").agg(F.count("*").alias("n_inputs"), F.when(F.count("tokens") == F.count("*"), F.sum("tokens")).cast("string").alias("tokens"), F.min("doc_id").alias("first_id"))


@query("SELECT conv_id AS request, count(*) AS n, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS complete FROM conversations GROUP BY conv_id")
def embed_response_order(spark, d):
    return K.response_order(table(spark, d, "conversations", F.col("conv_id").alias("request"), F.col("turn").alias("index")), "request")


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), e) AS score FROM embeddings, q)
SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def cosine_topk(spark, d):
    """The ten nearest vectors of the stated queries: every row whose id 50 divides."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return K.nearest(e, e.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


def _best(spark, d, k: int | None):
    """The k best documents (None: all) of the stated benchmark items (every 50th) by a deterministic number."""
    docs = table(spark, d, "documents", "doc_id", "n_chars")
    items = table(spark, d, "benchmark", "item_id").where("item_id % 50 = 0")
    return K.best_of(docs, items, (F.col("n_chars") * (F.col("item_id") + 3)) % 101, "item_id", "doc_id", k)


_RANK_SQL = "SELECT item_id, doc_id, (n_chars * (item_id + 3)) % 101 AS score FROM documents, (SELECT item_id FROM benchmark WHERE item_id % 50 = 0)"


@query(f"SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ({_RANK_SQL})) WHERE rank <= 5")
def rerank_topk(spark, d):
    return _best(spark, d, 5).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT item_id, doc_id AS index, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ({_RANK_SQL})) WHERE rank <= 5")
def rerank_chunk_rebase(spark, d):
    """Chunks of 32 documents, whose local indices are rebased before the one global cut."""
    cap = V.REQUEST_CAPS["tei"]
    s = _best(spark, d, None).select("item_id", "score", F.floor(F.col("doc_id") / cap).alias("chunk"), (F.col("doc_id") % cap).alias("local_index"))
    return K.top_k(K.rebased(s, cap), "item_id", "score", "index", 5).select("item_id", "index", F.col("rank").cast("long").alias("rank"))


@query("""SELECT o_custkey AS request, CASE WHEN min(o_orderkey % 20 - 1) < 0 OR max(o_orderkey % 20 - 1) >= 18 THEN 'index_range' WHEN count(DISTINCT o_orderkey % 20) < count(*) THEN 'index_repeated' WHEN count(*) > 12 THEN 'too_many' END AS error FROM orders GROUP BY 1""")
def rerank_validate(spark, d):
    r = table(spark, d, "orders", "o_custkey", "o_orderkey").select(F.col("o_custkey").alias("request"), (F.col("o_orderkey") % 20 - 1).alias("index"))
    return K.result_error(r, "request", "index", F.lit(18), 12)


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'query: ' WHEN 'de' THEN 'passage: ' ELSE '' END || source AS input, CASE lang WHEN 'en' THEN 'search_query' WHEN 'de' THEN 'search_document' WHEN 'fr' THEN 'search_document' END AS wire, lang = 'es' AS refused FROM documents""")
def input_type_prefix(spark, d):
    t = table(spark, d, "documents", "doc_id", "lang", "source")
    kind = F.when(F.col("lang") == "en", "query").when(F.col("lang") == "de", "document").when(F.col("lang") == "es", "image")
    wire, refused = V.wire_type(kind, V.COHERE_TYPES, "search_document")
    return t.select("doc_id", V.prefixed(F.col("source"), kind, "query: ", "passage: ").alias("input"), wire.alias("wire"), refused.alias("refused"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id AS VARCHAR) END AS n FROM events""")
def counter_parse(spark, d):
    """Whole numbers of 0 or more count; texts, fractions, negatives and booleans don't."""
    m, i = F.col("event_id") % 5, F.col("event_id").cast("string")
    token = F.when(m == 0, i).when(m == 1, F.concat(F.lit('"'), i, F.lit('"'))).when(m == 2, F.concat(i, F.lit(".5"))).when(m == 3, F.concat(F.lit("-"), i)).otherwise("true")
    return table(spark, d, "events", "event_id").select("event_id", V.counter(token).cast("string").alias("n"))


@query("""SELECT doc_id, array_to_string(list_concat(['a', 'b', 'a'], list_filter(list_distinct_ordered, lambda x: NOT list_contains(['a', 'b', 'a'], x))), ',') AS merged FROM (
SELECT doc_id, CASE WHEN lang = source THEN [lang] ELSE [lang, source] END AS list_distinct_ordered FROM documents)""")
def managed_extras_merge(spark, d):
    base = F.array(F.lit("a"), F.lit("b"), F.lit("a"))
    extra = F.array(F.col("lang"), F.lit("b"), F.col("source"), F.col("lang"))
    return table(spark, d, "documents", "doc_id", "lang", "source").select("doc_id", F.array_join(V.extras_union(base, extra), ",").alias("merged"))


@query("""SELECT l_linenumber AS status_no, l_orderkey, l_partkey, CASE WHEN s IN (401, 403) THEN 'provider_authentication' WHEN s = 400 AND r THEN 'provider_unsupported_content_block' WHEN s = 400 THEN 'provider_invalid_request'
WHEN s = 404 AND r THEN 'provider_invalid_model' WHEN s = 429 THEN 'provider_rate_limit' WHEN s = 503 AND r THEN 'provider_model_not_loaded' ELSE 'provider_unavailable' END AS category, count(*) AS n
FROM (SELECT *, [200, 400, 401, 403, 404, 429, 500, 503][CAST(l_suppkey % 8 AS INTEGER) + 1] AS s, l_returnflag = 'R' AS r FROM lineitem) GROUP BY ALL""")
def http_classification(spark, d):
    """Categories of completion statuses, refined by the body's code and message."""
    codes = F.array(*(F.lit(x) for x in (200, 400, 401, 403, 404, 429, 500, 503)))
    s, hit = F.get(codes, (F.col("l_suppkey") % 8).cast("int")), F.col("l_returnflag") == "R"
    code = F.when(hit & (s == 400), "unsupported_content_block").when(hit & (s == 404), "model_not_found")
    message = F.when(hit & (s == 503), "Model is loading")
    t = table(spark, d, "lineitem", "l_linenumber", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    return t.groupBy(F.col("l_linenumber").alias("status_no"), "l_orderkey", "l_partkey", V.http_category(s, "completion", code, None, message).alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS DOUBLE) WHEN s_suppkey % 3 = 1 THEN s_suppkey + 0.5 END AS seconds FROM supplier""")
def retry_after_parse(spark, d):
    m, k = F.col("s_suppkey") % 3, F.col("s_suppkey").cast("string")
    header = F.when(m == 0, k).when(m == 1, F.concat(k, F.lit(".5"))).otherwise("Wed, 21 Oct 2015 07:28:00 GMT")
    return table(spark, d, "supplier", "s_suppkey").select("s_suppkey", V.retry_after(header).alias("seconds"))


@query("""SELECT page_id, rtrim(url, '/') AS base, rtrim(url, '/') LIKE '%/v1' AS refused FROM pages""")
def base_url_check(spark, d):
    return table(spark, d, "pages", "page_id", "url").select("page_id", V.base_url(F.col("url")).alias("base"), V.refused_base_url(F.col("url")).alias("refused"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN source END AS echo FROM documents")
def document_echo(spark, d):
    """A string as it is, an object's text, null."""
    m = F.col("doc_id") % 3
    kind = F.when(m == 0, "string").when(m == 1, "object").otherwise("null")
    value = F.when(m == 0, F.col("source")).when(m == 1, F.to_json(F.struct(F.col("source").alias("text"))))
    return table(spark, d, "documents", "doc_id", "source").select("doc_id", V.echo_text(kind, value).alias("echo"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, true AS equal FROM embeddings")
def base64_decode(spark, d):
    """Vectors through base64 of little-endian floats and back."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")

    # to the wire format: the inverse of the decoder, for the round trip
    @F.pandas_udf("string")
    def wire(v):
        import base64

        import numpy as np

        return v.map(lambda x: base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())

    out = e.select("vec_id", "embedding", V.decoded_vector(wire("embedding")).alias("back"))
    return out.select("vec_id", F.size("back").cast("long").alias("n"), (F.col("back") == F.col("embedding")).alias("equal"))
