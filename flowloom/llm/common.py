"""Pieces that several training-data operators share.

* scratch tables in the cluster's shared checkpoint folder;
* word splitting and 64-bit hashing of whole Arrow text columns with numpy;
* connected components over an edge table;
* a let-binding for native Spark expressions.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Separators of words: ASCII blanks only, so that other Unicode spaces stay in words.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"

#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_ODD2 = 0xD1B54A32D192ED03


# ---------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, which all machines share.

    Only where that is unset and the session is a local one, as in tests, a folder below
    /tmp is used; on a cluster each machine would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return (base or "file:/tmp/checkpoints").rstrip("/") + "/flowloom"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows that a Python worker is sent at a time while a table is written: rows with texts or
#: sets are several KB, and either side of the pipe holds a batch or two.
BATCH, ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


class Scratch:
    """Writes tables to the shared folder and reads them again, which cuts lineage.

    A lost executor then repeats only the work since the last written table. `drop`
    deletes a table once no later step reads it; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self._end)

    def save(self, df: DataFrame, name: str = "t", **counts: Column) -> DataFrame:
        """df, written and read again; `counts` (name: condition) are how many of its rows
        meet each condition, gathered while writing and found in the result's `counted`."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        seen = Observation() if counts else None
        seen_df = df.observe(seen, *(F.count_if(c).alias(k) for k, c in counts.items())) if counts else df
        before = self.spark.conf.get(BATCH)
        self.spark.conf.set(BATCH, str(min(ROWS_A_BATCH, int(before)) if int(before) > 0 else ROWS_A_BATCH))
        try:
            seen_df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(BATCH, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        out.counted = seen.get if counts else {}
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            path = getattr(df, "_scratch_path", None)
            if path:
                _delete(self.spark, path)

    def _end(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session has ended before: its folder goes with it
            pass


# ---------------------------------------------------------------- native helpers


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it any number of times in `body`.

    A column that a lambda mentions is otherwise computed again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the words of a text (null: no words), native."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANKS))


# ---------------------------------------------------------------- texts in numpy


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, U64)
        p[0] = 1
        have = _powers[base] = np.multiply.accumulate(p)
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; all bits of the result depend on all of x."""
    x = x + U64((seed * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) % 2**64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_INV = pow(_ODD, -1, 2**64)
_INV2 = pow(_ODD2, -1, 2**64)


def rolling(h: np.ndarray, k: int, base: int = _ODD2) -> np.ndarray:
    """Hashes of all runs of k consecutive entries of h (len(h) - k + 1 of them)."""
    n = len(h)
    if n < k:
        return np.empty(0, U64)
    c = np.zeros(n + 1, U64)
    np.cumsum(h * powers(base, n), out=c[1:])
    inverse = _INV2 if base == _ODD2 else pow(base, -1, 2**64)
    return mix((c[k:] - c[:-k]) * powers(inverse, n - k + 1))


class Words:
    """The words of consecutive texts: where each starts and ends, and its 64-bit hash."""

    __slots__ = ("starts", "ends", "hashes", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        """data: the texts' bytes one after another; offsets: len(texts) + 1 places in it."""
        n = len(data)
        blank = _IS_BLANK[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        solid = ~blank
        before = np.empty(n, bool)
        before[:1] = True
        before[1:] = blank[:-1]
        self.starts = np.flatnonzero(solid & (before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1:] = True
        after[:-1] = blank[1:]
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        v = (_LOWER[data] if lower else data).astype(U64) + U64(1)
        c = np.zeros(n + 1, U64)
        np.cumsum(v * powers(_ODD, n), out=c[1:])
        self.hashes = mix((c[self.ends] - c[self.starts]) * powers(_INV, n)[self.starts] if n else np.empty(0, U64))
        #: first[i] is the index of text i's first word; one more entry at the end
        self.first = np.searchsorted(self.starts, offsets)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without copying; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold `limit` bytes at most, or one longer text."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def small_batches(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows each."""
    held, size = [], 0
    for batch in batches:
        for part in small_batches(batch, rows):
            held.append(part)
            size += part.num_rows
            if size >= rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


# ---------------------------------------------------------------- components


#: Edges that a task gathers before it contracts them (16 MB).
GATHERED = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every point of the edges that isn't the smallest of its component, and that smallest."""
    points, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(points))
    while len(x):
        x, y = root[x], root[y]
        open_ = x != y
        x, y = x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # a root is hung on a smaller one
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(points)))
    return points[own], points[root[own]]


def _forest_task(keyed: bool):
    """mapInArrow over edges (a, b): the partition's forest. Memory follows its points.

    `keyed` says that all edges of a point in `a` are in this partition; the column
    `foreign` then marks points that were only seen in `b` and have been hung up here.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.empty(0, np.int64)
        a, b, keys, new, size = z, z, z, [], 0

        def contracted():
            x, y = (np.concatenate([old, *(t[k] for t in new)]) for k, old in ((0, a), (1, b)))
            return *forest(x, y), np.union1d(keys, np.concatenate([z, *(t[0] for t in new)])) if keyed else z

        for batch in batches:
            new.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= GATHERED:
                a, b, keys = contracted()
                new, size = [], 0
        a, b, keys = contracted()
        cols, names = [pa.array(a), pa.array(b)], ["a", "b"]
        if keyed:
            cols.append(pa.array(~np.isin(a, keys)))
            names.append("foreign")
        yield pa.RecordBatch.from_arrays(cols, names=names)

    return task


def contracted(task: Callable) -> Callable:
    """A mapInArrow task that yields edges (a, b: long), followed by their contraction."""
    return lambda batches: _forest_task(False)(task(batches))


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60, roots: bool = True) -> DataFrame:
    """Connected components of `edges` (a, b: long): rows (id, component), the smallest id.

    Edges should come from tasks that have contracted theirs (`contracted`), so that a point
    with any number of neighbours leaves a task once. They are dealt by the larger id to as
    many tasks as their number asks for and contracted to forests; that is repeated until no
    task has hung up a point that belongs to another one: each point then has one parent. At
    last parents are replaced by theirs until all are roots. A hot root occurs only in joins,
    which adaptive execution splits. Every round is written to the shared folder. Loops and
    null ends are ignored; no edges give no rows. Without `roots` the smallest ids
    themselves have no row.
    """
    cur = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    cur = scratch.save(cur, "edges", rows=F.lit(True))
    for _ in range(max_rounds):
        tasks = max(1, -(-cur.counted["rows"] // GATHERED))
        dealt = cur.select("a", "b").repartition(tasks, "a").coalesce(tasks)
        nxt = scratch.save(dealt.mapInArrow(_forest_task(True), "a long, b long, foreign boolean"), "forest", foreign=F.col("foreign"), rows=F.lit(True))
        scratch.drop(cur)
        cur = nxt
        if tasks == 1 or not cur.counted["foreign"]:
            break
    else:
        raise RuntimeError("components: no forest within the rounds given")
    rest = max_rounds if tasks > 1 else 0  # a single task has hung every point on its root
    for _ in range(rest):
        up = cur.select(F.col("a").alias("p"), F.col("b").alias("q"))
        nxt = cur.join(up, cur["b"] == up["p"], "left").select("a", F.coalesce("q", "b").alias("b"), F.col("q").isNotNull().alias("moved"))
        nxt = scratch.save(nxt, "jump", moved=F.col("moved"))
        scratch.drop(cur)
        cur = nxt
        if not cur.counted["moved"]:
            break
    else:
        if rest:
            raise RuntimeError("components: chains are longer than the rounds given")
    out = cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
    if roots:
        out = out.unionByName(cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    return out
