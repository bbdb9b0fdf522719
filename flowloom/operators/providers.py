"""Embedding and reranking calls over tables: a client on the executors.

Clients are functions that ship to the executors; they raise ProviderError. Inputs go in
consecutive chunks of the provider's request cap; a chunk that fails marks its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TRANSIENT_CATEGORIES, ProviderError

#: client(texts) -> entries (index in the request, vector) in any order.
EmbedClient = Callable[[Sequence[str]], Sequence[tuple[int, Sequence[float]]]]
#: client(query, documents) -> (index, score) in any order, of some or all documents.
RerankClient = Callable[[str, Sequence[str]], Sequence[tuple[int, float]]]


def _tried(call: Callable[[], Sequence], attempts: int) -> Sequence:
    for k in range(attempts):
        try:
            return call()
        except ProviderError as e:
            if e.category not in TRANSIENT_CATEGORIES or k + 1 == attempts:
                raise
    raise ValueError("attempts must be 1 or more")


def _ordered(entries: Sequence[tuple[int, Sequence[float]]], n: int) -> list[list[float]]:
    """Vectors in input order; indices must be 0..n-1, each once, and lengths equal."""
    if sorted(i for i, _ in entries) != list(range(n)):
        raise ProviderError("provider_invalid_response", "indices aren't those of the inputs")
    vectors = [list(v) for _, v in sorted(entries, key=lambda e: e[0])]
    if len({len(v) for v in vectors}) > 1:
        raise ProviderError("provider_invalid_response", "vectors differ in length")
    return vectors


def embedded(rows: DataFrame, client: EmbedClient, id_col: str, text_col: str, cap: int, attempts: int = 1) -> DataFrame:
    """id, vector, category of each row. Empty and null texts are provider_invalid_request."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors: list = [None] * len(pdf)
            category: list = [None if t else "provider_invalid_request" for t in pdf["text"]]
            todo = [k for k, c in enumerate(category) if c is None]
            for i in range(0, len(todo), cap):
                part = todo[i : i + cap]
                texts = [pdf["text"].iloc[k] for k in part]
                try:
                    for k, v in zip(part, _ordered(_tried(lambda t=texts: client(t), attempts), len(part)), strict=True):
                        vectors[k] = v
                except ProviderError as e:
                    for k in part:
                        category[k] = e.category
            yield pd.DataFrame({"id": pdf["id"], "vector": vectors, "category": category})

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, vector array<double>, category string")


def reranked(rows: DataFrame, client: RerankClient, id_col: str, query_col: str, documents_col: str, cap: int, top_k: int | None = None, attempts: int = 1) -> DataFrame:
    """id, rank, index, score, category: each query's documents by falling score, ties in input order.

    documents_col is an array; chunks of cap are re-based to the whole list before the cut.
    A failed or invalid call is one row with its category.
    """

    def one(query: str, documents: Sequence[str]) -> list[tuple[int, float]]:
        got: list[tuple[int, float]] = []
        for i in range(0, len(documents), cap):
            part = list(documents[i : i + cap])
            scored = list(_tried(lambda p=part: client(query, p), attempts))
            at = [k for k, _ in scored]
            if len(set(at)) < len(at) or any(not 0 <= k < len(part) for k in at):
                raise ProviderError("provider_invalid_response", "indices repeat or lie outside")
            got += [(i + k, float(s)) for k, s in scored]
        got.sort(key=lambda e: (-e[1], e[0]))
        return got if top_k is None else got[:top_k]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[Mapping] = []
            for i, q, docs in zip(pdf["id"], pdf["query"], pdf["documents"], strict=True):
                try:
                    if not q or docs is None or not len(docs):
                        raise ProviderError("provider_invalid_request", "a query and documents are needed")
                    out += [{"id": i, "rank": r, "index": k, "score": s, "category": None} for r, (k, s) in enumerate(one(q, docs), 1)]
                except ProviderError as e:
                    out.append({"id": i, "rank": None, "index": None, "score": None, "category": e.category})
            yield pd.DataFrame(out, columns=["id", "rank", "index", "score", "category"]).astype({"rank": "Int64", "index": "Int64"})

    cols = [F.col(id_col).cast("long").alias("id"), F.col(query_col).alias("query"), F.col(documents_col).alias("documents")]
    return rows.select(*cols).mapInPandas(run, "id long, rank long, index long, score double, category string")
