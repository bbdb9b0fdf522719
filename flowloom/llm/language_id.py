"""Language identification in two steps: the family, then the language within it.

A linear support vector machine for each pair of families, and for each pair of languages
of one family, over hashed byte bigrams and trigrams of the whole text (A-Z in lower case;
what isn't a letter counts as a blank). The pairs vote; equal votes are settled by the sum
of margins. Scores are linear in the counts, so that a text of any length is scored in one
pass over its bytes.

Fitting uses `each` documents per language at most, picked by a hash; prediction never sees
a document's language, source or id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_buffers
from .linear_text import bounded_sample, id_hash, text_sums

BITS = 12
EACH = 400
#: Values of lang that are learned, the most frequent ones; documents to tell two families apart.
LANGUAGES, FAMILY_ROWS = 64, 4000
UNKNOWN = "und"

#: Families of languages by ISO 639-1 code; others are families of their own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "indo-aryan": "bn gu hi mr ne pa si ur",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower()[:2], lang)


_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigram and trigram that start at each byte; the last bytes meet blanks."""
    b = np.full(len(data) + 2, 32, np.uint32)
    b[:-2] = _LETTER[data]
    two = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B)
    three = two + b[2:] * np.uint32(0xC2B2AE35)
    return tuple(((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS) for x in (two, three))


def _vector(data: np.ndarray) -> np.ndarray:
    """A text's relative frequencies, scaled: bigrams, then trigrams."""
    out = np.concatenate([np.bincount(g, minlength=1 << BITS) for g in _grams(data)]).astype(np.float32)
    return out * (100 / max(len(data), 1))


def _vectors_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for i in range(0, batch.num_rows, 64):
            j = min(i + 64, batch.num_rows)
            vecs = [_vector(data[offsets[k] : offsets[k + 1]]) for k in range(i, j)]
            used = [np.flatnonzero(v).astype(np.int32) for v in vecs]
            at, value = (pa.array([x.tobytes() for x in xs], pa.binary()) for xs in (used, [v[u] for v, u in zip(vecs, used, strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), at, value], names=["lang", "at", "value"])


def fit_pair(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 150) -> np.ndarray:
    """Linear SVM (squared hinge, L2) by accelerated gradient descent; the last weight is a bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y < 0).sum(), 1)).astype(np.float32)
    # curvature bound: twice the largest eigenvalue of the weighted Gram matrix, by its trace
    step = 1 / (1e-3 + 2 * c * float((weight * (x**2).sum(1)).sum()))
    w = z = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        grad = 1e-3 * z - 2 * c * (x.T @ (weight * y * slack))
        new = z - step * grad
        z = new + (k / (k + 3)) * (new - w)
        w = new
    return w


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    families: tuple[str, ...]
    #: (True for families, winner's index, loser's index); a row of `weights` for each
    pairs: tuple[tuple[bool, int, int], ...]
    weights: np.ndarray

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language index and score (0 to 1) of each row of margins (texts x pairs)."""
        n = len(margins)
        chance = 1 / (1 + np.exp(-4 * margins))

        def elect(names: int, allowed, at: bool) -> tuple[np.ndarray, np.ndarray]:
            points, least = np.zeros((n, names)), np.ones((n, names))
            for k, (is_family, a, b) in enumerate(self.pairs):
                if is_family == at:
                    for who, p in ((a, chance[:, k]), (b, 1 - chance[:, k])):
                        points[:, who] += (p > 0.5) + 1e-6 * p
                        least[:, who] = np.minimum(least[:, who], p)
            points = np.where(allowed, points, -1.0)
            best = points.argmax(1)
            return best, least[np.arange(n), best]

        family, p = elect(len(self.families), np.ones((n, len(self.families)), bool), True)
        member = np.array([[family_of(x) == f for x in self.languages] for f in self.families])
        lang, q = elect(len(self.languages), member[family], False)
        return lang, p * q


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, each: int = EACH) -> LanguageModel | None:
    """A model from labelled documents; None if there are none.

    The sample holds about `each` documents of each of the LANGUAGES most frequent values of
    lang, as the features that they use; two families are told apart by FAMILY_ROWS of their
    documents at most.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("key")
    )
    sample = bounded_sample(labelled, "lang", each, "key", LANGUAGES).select("lang", "text").mapInArrow(_vectors_task, "lang string, at binary, value binary")
    rows = sorted((r["lang"], bytes(r["at"]), bytes(r["value"])) for r in sample.toLocalIterator())
    if not rows:
        return None

    def dense(chosen: np.ndarray) -> np.ndarray:
        x = np.zeros((len(chosen), 2 << BITS), np.float32)
        for i, k in enumerate(chosen):
            x[i, np.frombuffer(rows[k][1], np.int32)] = np.frombuffer(rows[k][2], np.float32)
        return x

    langs = [r[0] for r in rows]
    languages = tuple(sorted(set(langs)))
    families = tuple(sorted({family_of(name) for name in languages}))
    lang_no = np.array([languages.index(name) for name in langs])
    family_no = np.array([families.index(family_of(name)) for name in langs])
    pairs, weights = [], []
    for at, numbers, names in ((True, family_no, families), (False, lang_no, languages)):
        for a, b in combinations(range(len(names)), 2):
            if at or family_of(languages[a]) == family_of(languages[b]):
                k = np.flatnonzero((numbers == a) | (numbers == b))
                k = k[:: -(-len(k) // FAMILY_ROWS)]
                pairs.append((at, a, b))
                weights.append(fit_pair(dense(k), np.where(numbers[k] == a, 1, -1).astype(np.float32)))
    width = (2 << BITS) + 1
    return LanguageModel(languages, families, tuple(pairs), np.vstack(weights) if weights else np.zeros((0, width), np.float32))


def _predict_task(model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = model.value
        names = np.array(m.languages, object)
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            letters = batch.column(3).to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets):
                part, first = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                # two blanks behind each text, so that its last bytes don't meet the next one's
                at = np.arange(len(part)) + 2 * np.repeat(np.arange(j - i), np.diff(first))
                apart = np.full(len(part) + 2 * (j - i), 32, np.uint8)
                apart[at] = part
                two, three = (g[at] for g in _grams(apart))
                length = np.maximum(np.diff(first), 1)
                margins = np.empty((j - i, len(m.pairs)))
                for k, w in enumerate(m.weights):
                    margins[:, k] = w[-1] + 100 / length * text_sums(w[: 1 << BITS][two] + w[1 << BITS : 2 << BITS][three], first)
                lang, score = m.decide(margins)
                ok = letters[i:j].astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                        pa.array(np.where(ok, names[lang], UNKNOWN), pa.string()), pa.array(np.where(ok, score, 0.0)),
                    ],
                    names=["id", "held_out", "lang_pred", "score"],
                )

    return task


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held_out: int = 0, each: int = EACH) -> DataFrame:
    """A row for each row of docs: id, held_out, lang_pred, score (0 to 1).

    Documents whose id falls into the held-out fold aren't learned from. Null texts, texts
    without a letter, and every text where nothing is labelled are `und` with score 0. A
    null id belongs to the fold of the empty text. Equal texts get equal predictions; rows
    that repeat an id are learned from once. An empty table gives no rows; other columns
    aren't read. Long texts are read whole.
    """
    fold = id_hash(id_col) % folds == held_out
    model = fit(docs.where(~fold), id_col, text_col, lang_col, each)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), fold.alias("held_out"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_predict_task(docs.sparkSession.sparkContext.broadcast(model)), f"id {kind}, held_out boolean, lang_pred string, score double")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).withColumnRenamed("id", "doc_id")
