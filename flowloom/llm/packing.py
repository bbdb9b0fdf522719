"""Best-fit packing of documents into bins, without conflicts inside a bin.

A bin holds `capacity` tokens, at most one document of a source and one of a duplicate
cluster; it carries a bitmap of either. Longer documents are cut into pieces of a full bin
and a rest. Pieces are dealt by hash to shards of about `shard_rows` each, so that no
source or cluster gathers in one task; within a shard the longest go first, and each goes to
the bin with the least room that still takes it: the bins stand ordered by room left, and
the search goes on to the next roomier bin until one is compatible.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CAPACITY = 2048
SHARD_ROWS = 4096
#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin number and place in the bin of each item, in the order given.

    A null source or cluster is in conflict with nothing.
    """
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(c for c in clusters if c is not None))}
    room: list[tuple[int, int]] = []  # (tokens left, bin), in order; only bins that aren't full
    in_source: list[int] = []
    in_cluster: list[int] = []
    bins, places = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        sb, cb = source_bit.get(s, 0), cluster_bit.get(c, 0)
        i = bisect_left(room, (n, -1))
        while i < len(room) and (in_source[room[i][1]] & sb or in_cluster[room[i][1]] & cb):
            i += 1
        if i < len(room):
            left, b = room.pop(i)
        else:
            left, b = capacity, len(in_source)
            in_source.append(0)
            in_cluster.append(0)
        bins.append(b)
        places.append(capacity - left)
        in_source[b] |= sb
        in_cluster[b] |= cb
        if left > n:
            insort(room, (left - n, b))
    return bins, places


def _pack_shard(capacity: int):
    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("cluster", "ascending"), ("id", "ascending"), ("piece", "ascending")])
        bins, places = best_fit(t.column("n_tokens").to_pylist(), t.column("source").to_pylist(), t.column("cluster").to_pylist(), capacity)
        shard = t.column("shard").to_numpy().astype(np.int64)
        return pa.table(
            {"id": t.column("id"), "piece": t.column("piece"), "n_tokens": t.column("n_tokens"), "bin_id": (shard << 32) + np.array(bins, np.int64), "place": pa.array(places, pa.int64())}
        )

    return pack


def packed(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length=None, cluster=None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each piece of each document: id, piece, n_tokens, bin_id, place.

    `length` and `cluster` are expressions; by default the number of words, and a hash of
    the text in lower case. A document without tokens (null or empty text) is one piece of
    length 0 in no bin (null). Rows that occur twice are in one cluster, so in two bins. A
    null id is kept as it is. An empty table gives no rows; other columns aren't read. A very
    long text is as many pieces as it fills bins. Items of equal length go in the order of
    cluster, id and piece, so a packing doesn't change between runs.
    """
    length = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)) if length is None else length
    cluster = F.when(F.col(text_col).isNotNull(), F.xxhash64(F.lower(F.col(text_col).cast("string")))) if cluster is None else cluster
    source = F.col(source_col).cast("string") if source_col in docs.columns else F.lit(None).cast("string")
    items = docs.select(F.col(id_col).cast("long").alias("id"), length.cast("long").alias("n"), source.alias("source"), cluster.alias("cluster"))
    # a few numbers a document: the texts are read once for the count and the pieces
    items = Scratch(docs.sparkSession, "packing").save(items, "lengths")
    total = items.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_rows))
    pieces = (
        items.where("n > 0")
        .select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1)).alias("piece"))
        .select(
            "id", F.col("piece").cast("long").alias("piece"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long").alias("n_tokens"), "source", "cluster",
            F.pmod(F.xxhash64("id", "piece", "cluster"), F.lit(shards)).cast("int").alias("shard"),
        )
    )
    placed = pieces.groupBy("shard").applyInArrow(_pack_shard(capacity), "id long, piece long, n_tokens long, bin_id long, place long")
    none = items.where("n = 0").select("id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("place"))
    return placed.unionByName(none)


def packed_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The same by subword tokens, and with near duplicates as clusters.

    Lengths are those of the SentencePiece encoding, a cluster is a component of the MinHash
    operator. Both come by id, so ids should differ; rows that share one share its largest
    length and smallest component.
    """
    from .minhash_dedup import near_duplicates
    from .sentencepiece import encoded

    scratch = Scratch(docs.sparkSession, "tokens")
    lengths = scratch.save(encoded(docs, id_col=id_col, text_col=text_col).groupBy("id").agg(F.max("n_tokens").alias("_n")), "lengths")
    clusters = near_duplicates(docs, id_col, text_col).where("n_shingles > 0").groupBy("id").agg(F.min("component_id").alias("_c"))
    source = F.col(source_col).cast("string") if source_col in docs.columns else F.lit(None).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), source.alias("source"))
    both = slim.join(lengths, F.col("_id").eqNullSafe(lengths["id"])).drop("id")
    both = both.join(clusters, both["_id"].eqNullSafe(clusters["id"]), "left").select("_id", "source", "_n", "_c", F.lit("").alias("text"))
    return packed(both, id_col="_id", source_col="source", length=F.col("_n"), cluster=F.col("_c"), **options)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Per piece of a document: doc_id, piece, n_tokens, bin_id, place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return packed(docs).withColumnRenamed("id", "doc_id")
