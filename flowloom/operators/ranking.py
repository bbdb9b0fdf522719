"""Reranking and vector search over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .vector_search import best_pairs, packed


def top_k(scored: DataFrame, query: str | None, score: str, index: str, k: int | None) -> DataFrame:
    """Per query the k best by falling score; equal scores keep the input order.

    A row_number filter, which Spark evaluates with per-task group limits before the shuffle;
    without a query the sort is a global top-k. k None keeps all.
    """
    order = [F.col(score).desc_nulls_last(), F.col(index).asc()]
    if query is None:
        return scored.orderBy(*order).limit(k) if k is not None else scored.orderBy(*order)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def rebased(results: DataFrame, cap: int, chunk: str = "chunk", local: str = "local_index") -> DataFrame:
    """Results of consecutive chunks with their index in the whole input."""
    return results.withColumn("index", F.col(chunk) * cap + F.col(local))


def result_error(results: DataFrame, query: str, index: str, n_documents: Column, k: int) -> DataFrame:
    """Per query what is wrong with a rerank response: index_range, index_repeated, too_many."""
    g = results.groupBy(query).agg(
        F.min(index).alias("_lo"), F.max(index).alias("_hi"), F.count("*").alias("_n"), F.countDistinct(index).alias("_d"), F.max(n_documents).alias("_docs")
    )
    bad = F.when((F.col("_lo") < 0) | (F.col("_hi") >= F.col("_docs")), "index_range").when(F.col("_d") < F.col("_n"), "index_repeated").when(F.col("_n") > k, "too_many")
    return g.select(query, bad.alias("error"))


def best_of(items: DataFrame, queries: DataFrame, score: Column, query: str, index: str, k: int | None, max_queries: int = 10_000, block_bytes: int = 8 << 20, bytes_each: Column | None = None) -> DataFrame:
    """The k best items of each query by `score`, an expression of both tables' columns, with score and rank.

    The queries, a stated set, are counted with their bytes and dealt to blocks of about
    max_queries and block_bytes at most; each block is broadcast and meets all items, and
    each task keeps k rows a query before anything is shuffled. Ties go to the lower index.
    """
    out = None
    for own in _blocks(queries, query, max_queries, block_bytes, bytes_each if bytes_each is not None else F.lit(64)):
        top = top_k(items.crossJoin(F.broadcast(own)).select(query, index, score.alias("score")), query, "score", index, k)
        out = top if out is None else out.unionByName(top)
    return out


def _blocks(queries: DataFrame, query: str, max_queries: int, block_bytes: int, bytes_each: Column) -> list[DataFrame]:
    """The queries, dealt to blocks of bounded size."""
    size = queries.agg(F.coalesce(F.sum(bytes_each), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    blocks = max(1, -(-int(size["bytes"]) // block_bytes), -(-size["n"] // max_queries))
    return [queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == b) for b in range(blocks)]


#: Bytes of a chunk of vectors and of one of queries, at 8 bytes a number, and of the vectors of a task.
VECTOR_CHUNK, QUERY_CHUNK, TASK_BYTES = 4 << 20, 1 << 20, 32 << 20


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", max_queries: int = 10_000, block_bytes: int = 8 << 20) -> DataFrame:
    """The k most similar vectors of each query (a stated set) by cosine in double precision, ties to the lower id.

    Of a vector of norm 0 the cosine is 0, of null ones, or ones of another length, null. The
    vectors are dealt evenly and packed into chunks; each block of queries is packed, too, and
    broadcast. Two chunks are one row of the join and a matrix product in the task, so no row is
    made for a pair but for the k best of a query in a chunk.
    """
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, FloatType) else "<f8"
    dense = F.col(vector_col).cast(ArrayType(element if kind == "<f4" else "double"))
    size = vectors.agg(F.coalesce(F.sum(8 * F.greatest(F.size(vector_col), F.lit(1))), F.lit(0))).first()[0]
    tasks = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    q = queries.select(F.col(id_col).alias("query_id"), dense.alias("_q"))

    def chunks(rows: DataFrame, pre: str, keep: int | None, chunk_bytes: int) -> DataFrame:
        held = f"ids array<{rows.schema[0].dataType.simpleString()}>, dim int, data binary, chunk string"
        return rows.mapInArrow(packed(keep, chunk_bytes), held).select(*(F.col(c).alias(pre + c) for c in ("ids", "dim", "data", "chunk")))

    every = chunks(vectors.select(id_col, dense.alias("_v")).repartition(tasks), "v_", k, VECTOR_CHUNK).drop("v_chunk")
    name = vectors.schema[id_col].dataType.simpleString()
    out = None
    for own in _blocks(q, "query_id", max_queries, block_bytes, 8 * F.size("_q") + 16):
        asked = chunks(own.repartition(max(1, -(-block_bytes // QUERY_CHUNK) // 2)), "q_", None, QUERY_CHUNK)
        pairs = every.crossJoin(F.broadcast(asked)).mapInArrow(best_pairs(k, kind, ["query_id", id_col, "score"]), f"query_id {name}, `{id_col}` {name}, score double")
        top = top_k(pairs, "query_id", "score", id_col, k)
        out = top if out is None else out.unionByName(top)
    return out


def response_order(entries: DataFrame, request: str, index: str = "index") -> DataFrame:
    """Per request whether the entries' indices are exactly 0..n-1 (then sorting restores order)."""
    g = entries.groupBy(request).agg(F.count("*").alias("n"), F.min(index).alias("_lo"), F.max(index).alias("_hi"), F.countDistinct(index).alias("_d"))
    return g.select(request, "n", ((F.col("_lo") == 0) & (F.col("_hi") == F.col("n") - 1) & (F.col("_d") == F.col("n"))).alias("complete"))
