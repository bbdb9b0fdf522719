"""What the linear text models share: hashed positions, sums by text, bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]], in double precision; 0 for empty ranges.

    `first` runs from 0 to len(values). Each range is summed by itself: what stands before
    and behind it in the batch doesn't change a bit of its sum.
    """
    out = np.zeros(len(first) - 1)
    used = np.flatnonzero(np.diff(first) > 0)
    if len(used):
        out[used] = np.add.reduceat(np.asarray(values, float), first[used])
    return out


def id_hash(id_col: str) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def bounded_sample(rows: DataFrame, by: str, each: int, key: str, values: int = 64) -> DataFrame:
    """About `each` keys at most of each of the `values` most frequent values of `by`.

    Keys are picked by their hash. The rate of a value follows from its count over all rows,
    so the sample stays bounded whatever the table's size; a value with fewer rows keeps them
    all. Of rows with one key and one value the one with the smallest other columns stays,
    so a key that holds many rows counts once.
    """
    most = rows.where(F.col(by).isNotNull()).groupBy(by).count().orderBy(F.desc("count"), by).limit(values)
    counts = {r[by]: r["count"] for r in most.collect()}
    if not counts:
        return rows.limit(0)
    rate = F.create_map(*(F.lit(x) for v, n in counts.items() for x in (v, min(1.0, each / n))))
    unit = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(unit < F.element_at(rate, F.col(by)))
    others = [c for c in rows.columns if c not in (by, key)]
    if not others:
        return picked.distinct()
    return picked.groupBy(by, key).agg(F.min(F.struct(*others)).alias("_r")).select(by, key, "_r.*")


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, each: int) -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of about `each` documents at most of either label, and how many rows of `labels` have each.

    `labels` must be the rows to learn from: they are sampled first (2 * each at most in the
    mean), so what is broadcast to the documents is bounded. Ids with both labels are left
    out; one with several texts counts by the smallest.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_k"), F.col(label_col).cast("int").alias("label"))
    known = known.groupBy("_k").agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most").select("_k", "label")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    sample = F.broadcast(bounded_sample(known, "label", each, "_k"))
    rows = docs.join(sample, docs[id_col] == sample["_k"]).groupBy("_k", "label").agg(F.min(F.col(text_col).cast("string")).alias("text"))
    return rows.select("label", "text"), sizes
