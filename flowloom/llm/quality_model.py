"""Quality classifier: logistic regression over hashed word n-grams.

Features are relative frequencies of words and word pairs, both as written and as shapes
(runs of small letters, capitals, digits and marks: "Word!!" is "Aa!"), and of pairs of
equal words, hashed to 2 ** BITS weights. Training is follow-the-regularised-leader with
L1 and L2 terms, so most weights are zero; scoring is a sparse dot product that is linear in
the counts, one pass over a text of any length.

Fitting uses `each` documents of either label at most, picked by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _INV, _ODD, U64, Words, chunks, mix, powers, text_buffers
from .linear_text import id_hash, labelled_sample, text_sums

BITS = 18
EACH = 1200
THRESHOLD = 0.7

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[128:] = 97


def _shapes(data: np.ndarray, w: Words) -> np.ndarray:
    """Hash of each word's shape: its character classes without repeats."""
    if not len(w.starts):
        return np.empty(0, U64)
    c = _CLASS[data]
    keep = np.ones(len(c), bool)
    keep[1:] = c[1:] != c[:-1]
    keep[w.starts] = True
    rank = np.r_[0, np.cumsum(keep)]
    v = c[keep].astype(U64) + U64(1)
    s = np.r_[U64(0), np.cumsum(v * powers(_ODD, len(v)))]
    a, b = rank[w.starts], rank[w.ends]
    return mix((s[b] - s[a]) * powers(_INV, len(v) + 1)[a], 5)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight numbers (kinds x words) of each word's n-grams, and where each text's words start.

    A text's first word pairs with the start of the text.
    """
    w = Words(data, offsets)
    h, s = w.hashes, _shapes(data, w)
    opens = np.zeros(len(h), bool)
    opens[w.first[:-1][np.diff(w.first) > 0]] = True
    before = [np.where(opens, U64(0), np.r_[U64(0), x[:-1]]) if len(x) else x for x in (h, s)]
    kinds = (h, mix(before[0], 1) ^ h, s, mix(before[1], 2) ^ s, (before[0] == h).astype(U64))
    return np.stack([(mix(x, 31 + k) >> U64(64 - BITS)).astype(np.int32) for k, x in enumerate(kinds)]), w.first


def _sparse_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (label, text): each text's feature numbers and relative frequencies."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for i in range(batch.num_rows):
            grams, first = _features(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            at, count = np.unique(grams, return_counts=True)
            value = (count / max(int(first[-1]), 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([value.tobytes()], pa.binary())], names=["label", "at", "value"]
            )


class Ftrl:
    """Follow-the-regularised-leader (proximal) for logistic loss."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = weight * (p - label) * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", each: int = EACH, rounds: int = 6) -> np.ndarray | None:
    """Weights (the last one is the bias) from labelled documents; None if there are none.

    `labels` must be the rows to learn from. Ids with both labels are left out.
    """
    rows, sizes = labelled_sample(docs, labels, id_col, text_col, label_col, each)
    got = sorted((r["label"], bytes(r["at"]), bytes(r["value"])) for r in rows.mapInArrow(_sparse_task, "label int, at binary, value binary").toLocalIterator())
    if not got:
        return None
    data = [(np.append(np.frombuffer(a, np.int32), 1 << BITS), np.append(np.frombuffer(v, np.float32), 1.0).astype(float), y) for y, a, v in got]
    have = [sum(y == k for *_, y in data) for k in (0, 1)]
    # either label's documents weigh together what the label has among all labelled rows
    share = [sizes.get(k, 0) / max(sum(sizes.values()), 1) for k in (0, 1)]
    scale = [2 * share[k] * len(data) / (2 * max(have[k], 1)) for k in (0, 1)]
    model, random = Ftrl(1 << BITS), np.random.default_rng(3)
    for _ in range(rounds):
        for i in random.permutation(len(data)):
            at, value, y = data[i]
            model.learn(at, value, y, scale[y])
    return model.weights().astype(np.float32)


def _score_task(weights):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for i, j in chunks(offsets):
                grams, first = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                total = w[grams].sum(0, dtype=np.float64) if grams.size else np.empty(0)
                margin = w[-1] + text_sums(total, first) / np.maximum(np.diff(first), 1)
                score = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(score)], names=["id", "held_out", "score"])

    return task


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held_out: int = 2, each: int = EACH, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: id, held_out, score (0 to 1), predicted (score >= threshold).

    Labels of the held-out fold aren't learned from. Null and empty texts get the score of
    the bias alone. Without a label that is 0 or 1 every score is 0.5. Equal texts get equal
    scores. A null id belongs to the fold of the empty text and has no label; an id with
    both labels isn't learned from, and one with several texts by the smallest only. An empty
    table gives no rows; other columns aren't read. Long texts are read whole.
    """
    fold = id_hash(id_col) % folds == held_out
    weights = fit(docs, labels.where(~fold), id_col, text_col, label_col, each)
    rows = docs.select(F.col(id_col).alias("id"), fold.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    if weights is None:
        out = rows.select("id", "held_out", F.lit(0.5).alias("score"))
    else:
        kind = rows.schema["id"].dataType.simpleString()
        out = rows.mapInArrow(_score_task(docs.sparkSession.sparkContext.broadcast(weights)), f"id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_scores(docs, labels).withColumnRenamed("id", "doc_id")
