"""Embedding near-duplicates: a navigable small-world graph per shard, all shards queried.

1. Equal vectors become one class with a count, so that a vector of thousands of rows is one
   point. Classes are dealt to shards by hash; each shard's graph is built in one task and
   written to the shared folder.
2. Every two shards meet in one task (and each shard meets itself): the points of either
   query the graph of the other. A beam starts narrow, and each side audits it: AUDITED
   queries are compared with all the shard's vectors, and PLANTED more are made from sampled
   vectors turned just above the limit. While the search finds fewer than RECALL of these
   known links, the beam doubles. Then all queries search with it; one whose beam is full of
   links searches again with a wider one. A side whose widest beam still misses known links
   is compared exactly; so are two shards with more than PAIRS links, in blocks.
3. Pairs are verified by cosine in double precision on the vectors as given. A task sends no
   pairs: for each of its points the number of links, and the smallest point that its links
   lead to. Components are the union of these.

A shard's vectors take SHARD_BYTES at most, so the memory of a task is bounded whatever
their length; the number of shards is SHARDS for all smaller tables.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, forest
from .hnsw import Graph

COSINE = 0.95
SHARDS, SHARD_BYTES = 8, 1 << 27
#: Links of two shards that a task holds (8 bytes each); entries of beams that are wide at a time.
PAIRS, BEAMS = 1 << 25, 1 << 23
BEAM, WIDEST, AUDITED, PLANTED, RECALL = 32, 2048, 32, 256, 0.995
NEAR = 1e-4  # single precision finds pairs so far below the limit, double precision decides


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(n, -1) if n else np.zeros((0, 1))


def _build(t: pa.Table) -> pa.Table:
    order = np.argsort(t.column("rep").to_numpy())
    v = _matrix(t.column("vector"), t.num_rows)[order]
    g = Graph.build(_unit(v))
    blob = pickle.dumps((t.column("rep").to_numpy()[order], t.column("rows").to_numpy()[order], v, g.base, g.layers), protocol=5)
    return pa.table({"dim": t.column("dim").slice(0, 1), "shard": t.column("shard").slice(0, 1), "graph": pa.array([blob], pa.binary())})


def _links_of(graph: Graph, queries: np.ndarray, cosine: float, beam: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(query, point) pairs near the limit that the search finds; full beams widen.

    None if there are more than PAIRS of them.
    """
    n = len(graph.vectors)
    at, who, point, size = np.arange(len(queries)), [], [], 0
    near = cosine - NEAR
    while len(at):
        beam, wider = min(beam, n), []
        step = max(1, BEAMS // beam)
        for i in range(0, len(at), step):
            some = at[i : i + step]
            ids, sims = graph.search(queries[some], beam)
            full = (sims[:, -1] >= near) & (beam < n)
            q, k = np.nonzero((sims >= near) & (ids >= 0) & ~full[:, None])
            who.append(some[q])
            point.append(ids[q, k])
            wider.append(some[full])
            size += len(q)
            if size > PAIRS:
                return None
        at, beam = np.concatenate(wider), beam * 4
    return (np.concatenate(who), np.concatenate(point)) if who else (np.empty(0, int), np.empty(0, int))


def _compared(vectors: np.ndarray, queries: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) of all pairs from `near` up, by comparing each with each."""
    return np.nonzero(queries @ vectors.T >= near)


def planted(vectors: np.ndarray, count: int, cosine: float, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(point, query): sampled points, each turned so far that its cosine is a little above the limit."""
    point = random.integers(0, len(vectors), count)
    v = vectors[point].astype(np.float64)
    aside = random.normal(size=v.shape)
    aside -= (aside * v).sum(1, keepdims=True) * v
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    c = cosine + NEAR + random.random((count, 1)) * 0.4 * (1 - cosine)
    c[length < 1e-9] = 1  # with a single component there is nowhere to turn
    return point, (c * v + np.sqrt(1 - c**2) * aside / np.maximum(length, 1e-9)).astype(np.float32)


def passing_beam(graph: Graph, queries: np.ndarray, cosine: float, beam: int = BEAM) -> int | None:
    """The narrowest beam, by doubling, with which the search finds RECALL of the links known to the audit.

    Known are the links of AUDITED queries, compared with all points, and the points that
    PLANTED queries were turned from; so the audit is as large for a table without links as
    for one with many, and grows with the points of a shard only. None: not even WIDEST.
    """
    n, random = len(graph.vectors), np.random.default_rng(len(queries))
    some = queries[random.permutation(len(queries))[:AUDITED]]
    q, p = _compared(graph.vectors, some, cosine)
    point, turned = planted(graph.vectors, PLANTED, cosine, random)
    truth = np.r_[q * n + p, (len(some) + np.arange(PLANTED)) * n + point]
    asked = np.concatenate([some, turned])
    while True:
        got = _links_of(graph, asked, cosine, beam)
        if got is not None and np.isin(truth, got[0] * n + got[1]).sum() >= RECALL * len(truth):
            return beam
        if got is None or beam >= min(n, WIDEST):
            return None
        beam *= 2


def found_links(graph: Graph, queries: np.ndarray, cosine: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray] | None:
    """Links of unit queries that the graph's search finds with a beam that passes its audit.

    The few points that no path leads to are compared with all queries; only where no beam
    passes are all points. None: there are more than PAIRS links.
    """
    passes = passing_beam(graph, queries, cosine, beam)
    if passes is None:
        return _all_links(graph.vectors, queries, cosine)
    lost = unreached(graph)
    got, more = _links_of(graph, queries, cosine, passes), _all_links(graph.vectors[lost], queries, cosine)
    if got is None or more is None:
        return None
    found = np.isin(got[1], lost)
    return np.r_[got[0][~found], more[0]], np.r_[got[1][~found], lost[more[1]]]


def unreached(graph: Graph) -> np.ndarray:
    """Points that no path of base links leads to from the first point."""
    seen = np.zeros(len(graph.vectors), bool)
    new = np.arange(min(1, len(seen)))
    while len(new):
        seen[new] = True
        near = np.unique(graph.base[new])
        near = near[near >= 0]
        new = near[~seen[near]]
    return np.flatnonzero(~seen)


def _all_links(vectors: np.ndarray, queries: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray] | None:
    who, point, size = [np.empty(0, int)], [np.empty(0, int)], 0
    step = max(1, 8_000_000 // max(len(vectors), 1))
    for i in range(0, len(queries) if len(vectors) else 0, step):
        q, p = _compared(vectors, queries[i : i + step], cosine - NEAR)
        who.append(q + i)
        point.append(p)
        size += len(q)
        if size > PAIRS:
            return None
    return np.concatenate(who), np.concatenate(point)


class _Tally:
    """Verified links between the points of two shards (or of one): counts and forest."""

    def __init__(self, one: tuple, two: tuple, cosine: float):
        self.reps, self.rows, self.vectors = ([one[k], two[k]] for k in range(3))
        self.cosine, self.same = cosine, one is two
        self.counts = [np.zeros(len(r), np.int64) for r in self.reps]
        self.a = self.b = np.empty(0, np.int64)

    def add(self, q: np.ndarray, p: np.ndarray) -> None:
        """Pairs of points, each once."""
        for i in range(0, len(q), 100_000):
            x, y = q[i : i + 100_000], p[i : i + 100_000]
            a, b = self.vectors[0][x].astype(np.float64), self.vectors[1][y].astype(np.float64)
            ok = np.einsum("kd,kd->k", a, b) >= self.cosine * np.sqrt(np.einsum("kd,kd->k", a, a)) * np.sqrt(np.einsum("kd,kd->k", b, b))
            x, y = x[ok], y[ok]
            np.add.at(self.counts[0], x, self.rows[1][y])
            np.add.at(self.counts[1], y, self.rows[0][x])
            self.a, self.b = forest(np.r_[self.a, self.reps[0][x]], np.r_[self.b, self.reps[1][y]])

    def table(self) -> pa.Table:
        """id, n, root of each point with a link."""
        sides = ((self.reps[0], self.counts[0] + self.counts[1]),) if self.same else zip(self.reps, self.counts, strict=True)
        ids, n = (np.concatenate(x) for x in zip(*((r[c > 0], c[c > 0]) for r, c in sides), strict=True))
        root = ids.copy()
        if len(self.a):
            at = np.minimum(np.searchsorted(self.a, ids), len(self.a) - 1)
            root = np.where(self.a[at] == ids, self.b[at], ids)
        return pa.table({"id": ids, "n": n, "root": root})


def _meet(cosine: float):
    """applyInArrow on two shards' rows, or one's: (id, n, root)."""

    def task(t: pa.Table) -> pa.Table:
        sides = [pickle.loads(b) for _, b in sorted(zip(t.column("shard").to_pylist(), t.column("graph").to_pylist(), strict=True))]
        if len(sides) == 1 and t.column("p")[0] != t.column("q")[0]:  # the other shard is empty
            return pa.table({c: pa.array([], pa.int64()) for c in ("id", "n", "root")})
        one, two = sides[0], sides[-1]
        graphs = [Graph(_unit(x[2]), x[3], x[4]) for x in sides]
        (u, _), (v, g) = [(x.vectors, x) for x in (graphs[0], graphs[-1])]
        tally, n = _Tally(one, two, cosine), len(two[0])
        there = found_links(g, u, cosine)
        back = (there if one is two else found_links(graphs[0], v, cosine)) if there is not None else None
        if back is not None:
            q, p = np.r_[there[0], back[1]], np.r_[there[1], back[0]]
            if one is two:
                q, p = np.minimum(q, p)[q != p], np.maximum(q, p)[q != p]
            code = np.unique(q * n + p)
            tally.add(code // n, code % n)
        else:
            step = max(1, 8_000_000 // n)
            for i in range(0, len(u), step):
                q, p = _compared(g.vectors, u[i : i + step], cosine - NEAR)
                q = q + i
                tally.add(*((q[q < p], p[q < p]) if one is two else (q, p)))
        return tally.table()

    return task


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, shards: int = SHARDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each row of vectors: id, n_links, component_id, kept.

    n_links counts the other rows with cosine >= `cosine`; component_id is the smallest id in
    reach, kept says that it is the row's own. Vectors that are null, empty, zero or hold null
    or non-finite components have no links; so have vectors of different lengths with each
    other. Equal vectors are linked, rows that occur twice included. A row without id takes
    part through its vector; its component_id is null if no id is in reach. An empty table
    gives no rows; other columns aren't read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).withColumn("ok", usable(F.col("vector")))
    keyed = rows.select("id", "vector", "ok", F.when(F.col("ok"), F.xxhash64("vector")).alias("k1"), F.when(F.col("ok"), F.xxhash64(F.lit(29), F.reverse("vector"))).alias("k2"))
    # a class without any id is named by its hash
    classes = keyed.where("ok").groupBy("k1", "k2").agg(F.min("id").alias("low"), F.count("*").alias("rows"), F.first("vector").alias("vector"))
    classes = classes.withColumn("dim", F.size("vector")).withColumn("rep", F.coalesce("low", "k1"))
    classes = scratch.save(classes, "classes", nameless=F.col("low").isNull())
    largest = classes.groupBy("dim").count().agg(F.max(F.col("dim") * F.col("count"))).first()[0] or 0
    n_shards = max(shards, -(-8 * largest // shard_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = classes.select("dim", "rep", "rows", "vector", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(n_shards)).cast("int").alias("shard"))
    graphs = scratch.save(
        dealt.repartition(parts, "dim", "shard").groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, graph binary"), "graphs"
    )
    other = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("other")
    met = graphs.select("dim", "shard", "graph", other).select("dim", "shard", "graph", F.least("shard", "other").alias("p"), F.greatest("shard", "other").alias("q"))
    met = met.repartition(parts, "dim", "p", "q").groupBy("dim", "p", "q").applyInArrow(_meet(cosine), "id long, n long, root long")
    met = scratch.save(met, "links")
    comp = components(met.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch, roots=False)
    counts = met.groupBy(F.col("id").alias("of")).agg(F.sum("n").alias("n"))
    done = (
        classes.join(counts, classes["rep"] == counts["of"], "left")
        .join(comp, classes["rep"] == comp["id"], "left")
        .select("k1", "k2", "low", (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    done = scratch.save(done, "done")
    if classes.counted["nameless"]:  # a hash may be smaller than the smallest id
        real = done.groupBy("component_id").agg(F.min("low").alias("real"))
        done = done.join(real, "component_id").drop("component_id").withColumnRenamed("real", "component_id")
    scratch.drop(graphs, met)
    out = keyed.select("id", "ok", "k1", "k2").join(done.drop("low"), ["k1", "k2"], "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return similar_vectors(vectors).withColumnRenamed("id", "vec_id")


#: The same in DuckDB: all pairs.
OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT reach.v, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT v AS vec_id, (SELECT count(*) FROM link WHERE link.a = t.v) AS n_links, m AS component_id, v = m AS kept
FROM (SELECT v, min(r) AS m FROM reach GROUP BY v) t
"""
