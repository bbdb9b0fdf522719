"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's chance is a logistic score of the distinct words in it and of their beginnings
of 3 to 6 bytes (letters and digits only, A-Z in lower case), hashed to 2 ** BITS weights. A
document's chance is the noisy-or of its sentences, 1 - prod(1 - p). Only documents have
labels: the gradient of the noisy-or gives each sentence its share of the blame, so that the
sentences which only toxic documents have take it over. The same weights then name the
offending sentences. Training is follow-the-regularised-leader with an L1 term that leaves
what occurs in a few documents only at zero; scoring looks at the few thousand others.

A sentence ends at `.`, `!`, `?` or a line break; one without a word doesn't count.

Fitting uses `each` documents of either label at most, picked by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _INV, _ODD, U64, chunks, mix, powers, text_buffers
from .linear_text import id_hash, labelled_sample
from .quality_model import Ftrl

BITS = 18
EACH = 1500
THRESHOLD = 0.5
#: Lengths in bytes of the beginnings of words that count as features.
BEGINNINGS = (3, 4, 5, 6)

_WORD = np.zeros(256, np.uint8)
_WORD[48:58] = np.arange(48, 58)
_WORD[97:123] = np.arange(97, 123)
_WORD[65:91] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x21, 0x2E, 0x3F]] = True


class Sentences:
    """The sentences of consecutive texts that hold a word, and their distinct features.

    start, end: bytes of each sentence, from its first word to its last one's end; text: its
    text's number; sentence, feature: a row for each distinct feature of each sentence, in
    order of both.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, useful: np.ndarray | None = None):
        """useful: which weights differ from zero; features of the others are left out."""
        n = len(data)
        letters = _WORD[data]
        solid = letters > 0
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~solid[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~solid[1:]
        starts = np.flatnonzero(solid & (before | edge[:-1]))
        ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self._spans(data, offsets, starts, ends)
        sums = np.zeros(n + 1, U64)
        np.cumsum((letters.astype(U64) + U64(1)) * powers(_ODD, n), out=sums[1:])
        size, back = ends - starts, powers(_INV, n + 1)[starts]
        of, features = [self.of_word], [self._hashed((sums[ends] - sums[starts]) * back, 0)]
        for k in BEGINNINGS:
            longer = np.flatnonzero(size > k)
            of.append(self.of_word[longer])
            features.append(self._hashed((sums[starts[longer] + k] - sums[starts[longer]]) * back[longer], k))
        sentence, feature = np.concatenate(of), np.concatenate(features)
        if useful is not None:
            kept = useful[feature]
            sentence, feature = sentence[kept], feature[kept]
        both = np.unique(sentence.astype(np.int64) << BITS | feature)
        self.sentence, self.feature = both >> BITS, both & ((1 << BITS) - 1)

    @staticmethod
    def _hashed(h: np.ndarray, kind: int) -> np.ndarray:
        return (mix(h, 41 + kind) >> U64(64 - BITS)).astype(np.int64)

    def _spans(self, data, offsets, starts, ends) -> None:
        stops = np.flatnonzero(_STOP[data])
        text = np.searchsorted(offsets, starts, "right") - 1
        block = np.searchsorted(stops, starts)
        new = np.ones(len(starts), bool)
        new[1:] = (block[1:] != block[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        self.of_word = np.cumsum(new) - 1
        self.start, self.text = starts[first], text[first]
        self.end = ends[np.append(first[1:], len(starts)) - 1] if len(first) else ends[:0]

    def margins(self, weights: np.ndarray) -> np.ndarray:
        """A sentence's weights are added one after another, so its neighbours don't matter."""
        return weights[-1] + np.bincount(self.sentence, weights[self.feature], len(self.start))


def _bags_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (label, text): each text's features, and how many each sentence has."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for i in range(batch.num_rows):
            s = Sentences(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            count = np.bincount(s.sentence, minlength=len(s.start))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), pa.array([s.feature.astype(np.int32).tobytes()], pa.binary()), pa.array([count.astype(np.int32).tobytes()], pa.binary())],
                names=["label", "at", "count"],
            )


def blame(margin: np.ndarray, label: int) -> np.ndarray:
    """The loss's derivative by each sentence's margin, for a document's label under noisy-or."""
    chance = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
    if not label:
        return chance
    none = np.logaddexp(0, np.clip(margin, -35, 35)).sum()  # -log of the chance that no sentence is toxic
    return -chance / np.expm1(max(none, 1e-9))


class BagFtrl(Ftrl):
    """Follow-the-regularised-leader whose examples are documents of several sentences."""

    def learn_bag(self, at: np.ndarray, sentence: np.ndarray, sentences: int, label: int, weight: float) -> None:
        """at: the features of all sentences, one after another; sentence: whose they are."""
        own, place = np.unique(at, return_inverse=True)
        own = np.append(own, len(self.z) - 1)
        w = self.weights(own)
        g = np.clip(weight * blame(w[-1] + np.bincount(sentence, w[place], sentences), label), -1, 1)
        grad = np.append(np.bincount(place, g[sentence], len(own) - 1), g.sum())
        sigma = (np.sqrt(self.n[own] + grad**2) - np.sqrt(self.n[own])) / self.alpha
        self.z[own] += grad - sigma * w
        self.n[own] += grad**2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", each: int = EACH, rounds: int = 8) -> np.ndarray | None:
    """Weights (the last one is the bias) from labelled documents; None if there are none.

    Either label's documents weigh together what the label has among all labelled rows. A
    document without a sentence teaches nothing.
    """
    rows, sizes = labelled_sample(docs, labels, id_col, text_col, label_col, each)
    got = sorted((r["label"], bytes(r["at"]), bytes(r["count"])) for r in rows.mapInArrow(_bags_task, "label int, at binary, count binary").toLocalIterator())
    data = [(y, np.frombuffer(a, np.int32), np.frombuffer(c, np.int32)) for y, a, c in got if c]
    if not data:
        return None
    have = [sum(y == k for y, *_ in data) for k in (0, 1)]
    share = [sizes.get(k, 0) / max(sum(sizes.values()), 1) for k in (0, 1)]
    scale = [share[k] * len(data) / max(have[k], 1) for k in (0, 1)]
    model, random = BagFtrl(1 << BITS, l1=0.5), np.random.default_rng(3)
    # before anything is known a document has the chance that its label's share says
    n = sum(len(c) * scale[y] for y, _, c in data) / sum(scale[y] for y, *_ in data)
    start = np.log(max(share[1], 1e-3) / max(n, 1.0))
    model.z[-1] = -start * (model.beta / model.alpha + model.l2) + np.sign(-start) * model.l1
    for _ in range(rounds):
        for i in random.permutation(len(data)):
            y, at, count = data[i]
            model.learn_bag(at, np.repeat(np.arange(len(count)), count), len(count), y, scale[y])
    return model.weights().astype(np.float32)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _score_task(weights, threshold: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value.astype(float)
        useful = w[:-1] != 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for i, j in chunks(offsets):
                part, first = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                s = Sentences(part, first, useful)
                margin = s.margins(w)
                none = np.bincount(s.text, np.logaddexp(0, margin), j - i)
                with np.errstate(over="ignore"):
                    score, own = 0.0 - np.expm1(-none), 1 / (1 + np.exp(-margin))
                most = np.zeros(j - i)
                np.maximum.at(most, s.text, own)
                # a toxic text has an offending sentence: its worst, if none reaches the limit alone
                bad = np.flatnonzero((score[s.text] >= threshold) & (own >= np.minimum(threshold, most[s.text])))
                points = np.zeros(len(part) + 1, np.int64)
                np.cumsum((part & 0xC0) != 0x80, out=points[1:])
                base = points[first[s.text[bad]]]
                spans = pa.StructArray.from_arrays([pa.array(points[s.start[bad]] - base), pa.array(points[s.end[bad]] - base), pa.array(own[bad])], fields=list(_SPANS.value_type))
                count = lambda x: np.bincount(x, minlength=j - i)
                ends = np.r_[0, np.cumsum(count(s.text[bad]))].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(score), pa.array(count(s.text).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), spans, type=_SPANS),
                    ],
                    names=["id", "held_out", "score", "n_sentences", "offending"],
                )

    return task


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out: int = 0, each: int = EACH, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: id, held_out, score (0 to 1), n_sentences, offending, predicted.

    `offending` are the sentences of a predicted text whose own score reaches the threshold,
    or its worst ones: start, end (code points, end exclusive) and score, in order.

    Labels of the held-out fold aren't learned from. Null texts and texts without a word have
    no sentence and the score 0. Without a label that is 0 or 1 every score is 0. Equal texts
    get equal scores, whatever stands beside them. A null id belongs to the fold of the empty
    text and has no label; an id with both labels isn't learned from, and one with several
    texts by the smallest only. An empty table gives no rows; other columns aren't read. Long
    texts are read whole.
    """
    fold = id_hash(id_col) % folds == held_out
    weights = fit(docs, labels.where(~fold), id_col, text_col, label_col, each)
    if weights is None:
        weights = np.append(np.zeros(1 << BITS), -np.inf).astype(np.float32)
    rows = docs.select(F.col(id_col).alias("id"), fold.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = f"id {kind}, held_out boolean, score double, n_sentences long, offending array<struct<start: long, end: long, score: double>>"
    out = rows.mapInArrow(_score_task(docs.sparkSession.sparkContext.broadcast(weights), threshold), made)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted; n_sentences, and offending spans as start:end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    spans = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return toxicity_scores(docs, labels).select(F.col("id").alias("doc_id"), "held_out", "score", "predicted", "n_sentences", spans.alias("offending"))
