"""Chunks of vectors against chunks of queries: dense products in tasks, scores as written out.

A chunk is a row: the ids of some vectors of one length, and their numbers. The products of two
chunks are one matrix product, which only rules pairs out: those within its rounding of the k
best are scored again term by term, in double precision and in the vector's order, so a score
depends on the two vectors alone and equal vectors tie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Products of two chunks that are held at once.
PRODUCTS = 1 << 21


def packed(k: int | None, chunk_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, vector) as chunks (ids, dim, data, chunk) by rising id, of one vector length each.

    dim is -1 where a vector is null or has a null in it. With k, of equal vectors in a chunk
    only the k with the lowest ids stay: those tie, and the others can't be among the k best.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            batch = batch.take(pc.array_sort_indices(batch.column(0), null_placement="at_start"))
            ids, vectors = batch.column(0), batch.column(1)
            dims = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
            if vectors.flatten().null_count:
                nulls = pc.list_parent_indices(vectors).filter(pc.is_null(vectors.flatten()))
                dims = dims.copy()
                dims[nulls.to_numpy(zero_copy_only=False)] = -1
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                step = max(1, chunk_bytes // max(64, 8 * int(dim)))
                for some in (rows[i : i + step] for i in range(0, len(rows), step)):
                    data = b""
                    if dim > 0:
                        matrix = vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), dim)
                        if k is not None:
                            kept = _first(matrix, k)
                            some, matrix = some[kept], matrix[kept]
                        data = matrix.tobytes()
                    elif k is not None:
                        some = some[:k]
                    n += 1
                    taken = ids.take(pa.array(some))
                    whole = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), taken)
                    yield pa.RecordBatch.from_arrays([whole, pa.array([int(dim)], pa.int32()), pa.array([data], pa.binary()), pa.array([f"{place}-{n}"])], ["ids", "dim", "data", "chunk"])

    return pack


def _first(matrix: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k of each set of equal rows, rising."""
    rows = np.ascontiguousarray(matrix)
    _, same = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    return np.sort(order[_ranks(same[order]) < k])


def _ranks(groups: np.ndarray) -> np.ndarray:
    """Each entry's place in its group, from 0; groups stand together."""
    n = np.arange(len(groups))
    new = np.r_[True, groups[1:] != groups[:-1]] if len(groups) else np.zeros(0, bool)
    return n - np.maximum.accumulate(np.where(new, n, 0))


class _Side:
    """A chunk: its ids, vectors (n by dim), and squares of norms, summed in order (null: NaN and `lacks`)."""

    def __init__(self, ids: pa.Array, dim: int, data: bytes, kind: str):
        self.ids, self.n, self.lacks = ids, len(ids), dim < 0
        self.vectors = np.frombuffer(data, kind).reshape(self.n, max(0, dim)).astype("<f8")
        self.squares = np.full(self.n, np.nan) if self.lacks else _in_order(self.vectors * self.vectors)
        zero, self.odd = self.squares == 0, ~((self.squares == 0) | ((self.squares > 1e-140) & (self.squares < 1e140)))
        self.zero = zero
        scale = np.sqrt(np.where(self.odd | zero, 1.0, self.squares))
        self.unit = np.where((self.odd | zero)[:, None], 0.0, self.vectors) / scale[:, None]
        self.columns = np.ascontiguousarray(self.vectors.T)


def _in_order(terms: np.ndarray) -> np.ndarray:
    return np.add.accumulate(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))


def _scores(q: _Side, v: _Side, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
    """Cosines of pairs, 0 where either norm is 0; NaN counts as infinity, null as its negative."""
    if q.lacks or v.lacks or q.vectors.shape[1] != v.vectors.shape[1]:
        score = np.full(len(qi), -np.inf)
    else:
        dot = np.zeros(len(qi))
        for a, b in zip(q.columns, v.columns):
            dot += a[qi] * b[vi]
        score = np.clip(dot / np.sqrt(q.squares[qi] * v.squares[vi]), -1.0, 1.0)
        score[np.isnan(score)] = np.inf
    score[q.zero[qi] | v.zero[vi]] = 0.0
    return score


def _candidates(q: _Side, v: _Side, rows: slice, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may be among the k best of their query: none of those is missing."""
    n = rows.stop - rows.start
    if q.lacks or v.lacks or q.vectors.shape[1] != v.vectors.shape[1]:
        # 0 with vectors of norm 0, else null; ids rise, so the first k of both are enough
        some = np.sort(np.r_[np.flatnonzero(v.zero)[:k], np.flatnonzero(~v.zero)[:k]])
        return np.repeat(np.arange(rows.start, rows.stop), len(some)), np.tile(some, n)
    about = q.unit[rows] @ v.unit.T
    about[q.odd[rows]] = np.inf
    about[:, v.odd] = np.inf
    margin = 16 * (q.vectors.shape[1] + 8) * np.finfo("f8").eps
    may = about >= (floor[rows] - margin)[:, None]
    if v.n > k and np.count_nonzero(may) > 4 * k * n:
        may &= about >= (np.partition(about, v.n - k, axis=1)[:, v.n - k] - margin)[:, None]
    qi, vi = np.nonzero(may)
    return qi + rows.start, vi


def best_pairs(k: int, kind: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a chunk of vectors and one of queries as (query, id, score): the k best of each query in the chunk.

    What can't be among the k best of the task so far is left out.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, np.ndarray] = {}
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                v, q = (_Side(col[p + "ids"][r].values, col[p + "dim"][r].as_py(), col[p + "data"][r].as_py(), kind) for p in ("v_", "q_"))
                name = col["q_chunk"][r].as_py()
                had = best.get(name, np.full((q.n, k), -np.inf))
                floor, new = had.min(axis=1), np.full((q.n, k), -np.inf)
                step = max(1, PRODUCTS // max(1, v.n))
                for i in range(0, q.n, step):
                    qi, vi = _candidates(q, v, slice(i, min(q.n, i + step)), floor, k)
                    with np.errstate(all="ignore"):
                        score = _scores(q, v, qi, vi)
                    order = np.lexsort((-score, qi))  # stable: equal scores by rising id
                    rank = _ranks(qi[order])
                    kept = order[(rank < k) & (score[order] >= floor[qi[order]])]
                    qi, vi, score = qi[kept], vi[kept], score[kept]
                    new[qi, _ranks(qi)] = score
                    shown = np.where(np.isposinf(score), np.nan, score)
                    yield pa.RecordBatch.from_arrays([q.ids.take(pa.array(qi)), v.ids.take(pa.array(vi)), pa.array(shown, mask=np.isneginf(score))], names)
                best[name] = -np.partition(-np.concatenate([had, new], axis=1), k - 1, axis=1)[:, :k]

    return meet
