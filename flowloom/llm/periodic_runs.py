"""Periodic runs of words: stretches that repeat with a period, four times or more.

A run is a stretch of words with smallest period q and a length of at least max(6, 4 q)
that neither neighbour extends. Its word i and word i + q agree over its length less q,
which is `K` or more; so each of its words lies in a K-gram of words that occurs again in
the document. Words outside such K-grams are masked: they can't belong to a run, and runs
don't reach across them. Only what survives is searched, by Main and Lorentz's division:
each surviving segment is halved again and again, and a run is found at a centre that it
crosses, from how far the words before and behind the centre agree with those one period on.

All texts of a batch go through it together. At each level the centres of all segments are
paired with all periods that fit (4 q <= block); a pair lives on only if three words in a
row agree on one side of the centre, which a run's overlap of K or more guarantees. How far
agreement goes is then found by doubling steps on prefix hashes. Words are compared by 64-bit
hashes, within one document only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _INV2, _ODD2, U64, Words, chunks, let, mix, powers, rolling, text_buffers, words_of

#: A run's least length, and its least number of periods.
LEAST, TIMES = 6, 4
#: The least length at which a run's words agree with those a period on: LEAST - 1 with
#: period 1, and (TIMES - 1) q >= 6 with longer ones.
K = LEAST - 1
#: Pairs of centre and period that one step holds.
PAIRS = 1 << 20


def surviving(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words covered by K-grams that occur twice in their text.

    words: hashes of all texts' words, one text after another; text: each word's text.
    """
    n = len(words)
    grams = rolling(words, K)
    if not len(grams):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    whole = np.flatnonzero(text[K - 1 :] == text[: n - K + 1])
    key = grams[whole] ^ mix(text[whole].astype(U64), 7)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(whole), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    cover[whole[again]] += 1
    cover[whole[again] + K] -= 1
    return stretches(np.cumsum(cover[:-1]) > 0, text)


def stretches(held: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of LEAST or more held words of one text."""
    opens, closes = held.copy(), held.copy()
    edge = text[1:] != text[:-1]
    opens[1:] &= ~held[:-1] | edge
    closes[:-1] &= ~held[1:] | edge
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = b - a >= LEAST
    return a[long], b[long]


class _Line:
    """Segments one after another, apart by marks that equal nothing."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts
        self.first = 1 + np.cumsum(np.r_[0, size[:-1] + 1])  # where each segment begins in the line
        self.last = self.first + size
        n = int(self.last[-1]) + 1
        self.word = mix(np.arange(n, dtype=U64), 99)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.word[np.repeat(self.first, size) + place] = words[np.repeat(starts, size) + place]
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(self.word * powers(_ODD2, n), out=self.sums[1:])
        self.back = powers(_INV2, n + 1)
        three = rolling(self.word, 3)
        self.three = np.r_[three, mix(np.arange(n - len(three), dtype=U64), 77)]
        self.top = max(int(size.max()).bit_length(), 1)

    def equal(self, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        """Whether k words from x and from y agree."""
        return (self.sums[x + k] - self.sums[x]) * self.back[x] == (self.sums[y + k] - self.sums[y]) * self.back[y]

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x < y on agree; marks end it at the segment's end at last."""
        n, got = len(self.word), np.zeros(len(x), np.int64)
        for t in range(self.top, -1, -1):
            k = 1 << t
            fits = np.flatnonzero(y + got + k <= n)
            got[fits[self.equal(x[fits] + got[fits], y[fits] + got[fits], k)]] += k
        return got

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words before x < y agree."""
        got = np.zeros(len(x), np.int64)
        for t in range(self.top, -1, -1):
            k = 1 << t
            fits = np.flatnonzero(x - got - k >= 0)
            got[fits[self.equal(x[fits] - got[fits] - k, y[fits] - got[fits] - k, k)]] += k
        return got


def _centres(line: _Line, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, segment) of the centres of all blocks of a size, as many at a time as PAIRS allows."""
    half = block // 2
    count = np.maximum(0, -(-(line.last - line.first - half) // block))
    whose = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count)
    centre = line.first[whose] + half + number * block
    each = max(1, PAIRS // max(block // TIMES, 1))
    for i in range(0, len(centre), each):
        yield centre[i : i + each], whose[i : i + each]


def main_lorentz(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of the runs in the segments, in order of start and period."""
    if not len(starts):
        return (np.empty(0, np.int64),) * 3
    line = _Line(words, starts, ends)
    found = [np.empty((0, 3), np.int64)]
    block = 8  # the smallest aligned block that can hold a run
    while block // 2 < int((ends - starts).max()):
        for centre, whose in _centres(line, block):
            for q in _periods(block):
                found.append(_crossing(line, centre, whose, q))
        if len(found) > 64:
            found = [np.unique(np.concatenate(found), axis=0)]
        block *= 2
    runs = np.unique(np.concatenate(found), axis=0)  # by start, end, period
    if len(runs):
        runs = runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)]]  # a multiple of a run's period gives the same run
    segment = np.searchsorted(line.first, runs[:, 0], "right") - 1
    shift = starts[segment] - line.first[segment]
    order = np.lexsort((runs[:, 2], runs[:, 0]))
    return runs[order, 0] + shift[order], runs[order, 1] + shift[order], runs[order, 2]


def _periods(block: int) -> Iterator[np.ndarray]:
    """The periods that a run inside a block can have, some at a time."""
    top = max(block // TIMES, 1)
    for i in range(1, top + 1, PAIRS):
        yield np.arange(i, min(i + PAIRS, top + 1))


def _crossing(line: _Line, centre: np.ndarray, whose: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Runs (start, end, period) with a word of their first or last period at a centre."""
    out = []
    for left in (False, True):  # the centre's words agree with those a period on, or a period before
        x = np.repeat(centre, len(periods)) if not left else (centre[:, None] - periods).ravel()
        q, s = np.tile(periods, len(centre)), np.repeat(whose, len(periods))
        inside = np.flatnonzero((x >= line.first[s]) & (x + q < line.last[s]))
        x, q = x[inside], q[inside]
        before = np.maximum(x - 3, 0)
        alive = (line.three[x] == line.three[x + q]) | (line.three[before] == line.three[before + q])
        x, q = x[alive], q[alive]
        a, b = x - line.backward(x, x + q), x + q + line.forward(x, x + q)
        long = b - a >= np.maximum(LEAST, TIMES * q)
        out.append(np.stack([a[long], b[long], q[long]], 1))
    return np.concatenate(out)


def runs_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, period) of all runs; text i has the words first[i]:first[i + 1].

    Starts and ends count from a text's first word; in order of text, start and period.
    """
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    a, b, q = main_lorentz(words, *surviving(words, text))
    whose = text[a]
    return whose, a - first[whose], b - first[whose], q


# ------------------------------------------------------------------ tables


def _collapsed(data: np.ndarray, w: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of all texts, joined by blanks and each text's put one after another, and where each text begins."""
    size = np.where(keep, w.ends - w.starts + 1, 0)
    at = np.repeat(np.flatnonzero(keep), size[keep])
    place = np.arange(len(at)) - np.repeat(np.cumsum(size[keep]) - size[keep], size[keep])
    last = place == (size[at] - 1)
    out = np.full(len(at), 32, np.uint8)
    out[~last] = data[w.starts[at[~last]] + place[~last]]
    return out.tobytes(), np.r_[0, np.cumsum(size)][w.first]


def _best(start, end, period) -> int:
    """The run with the greatest exact length / period; ties by start, then period."""
    length = end - start
    near = np.flatnonzero(length / period >= (length / period).max() * (1 - 1e-9))
    return max(near, key=lambda k: (Fraction(int(length[k]), int(period[k])), -start[k], -period[k]))


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _runs_task(with_runs: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                part = data[offsets[i] : offsets[j]]
                w = Words(part, offsets[i : j + 1] - offsets[i])
                n = j - i
                whose, a, b, q = runs_of(w.hashes, w.first)
                drop = np.zeros(len(w.starts) + 1, np.int64)
                np.add.at(drop, w.first[whose] + a + q, 1)
                np.add.at(drop, w.first[whose] + b, -1)
                text, begin = _collapsed(part, w, np.cumsum(drop[:-1]) == 0)
                bounds = np.searchsorted(whose, np.arange(n + 1))
                top: list[list[int | None]] = [[None] * n for _ in range(4)]
                said, kept = [], []
                for k in range(n):
                    own = slice(bounds[k], bounds[k + 1])
                    x, y, p = a[own], b[own], q[own]
                    if len(x):
                        m = _best(x, y, p)
                        for column, value in zip(top, (x[m], y[m] - x[m], p[m], 1000 * (y[m] - x[m]) // p[m]), strict=True):
                            column[k] = int(value)
                    lines = "".join(f"{s},{e - s},{r}\n" for s, e, r in zip(x.tolist(), y.tolist(), p.tolist(), strict=True))
                    said.append(hashlib.sha256(lines.encode()).hexdigest())
                    kept.append(hashlib.sha256(text[begin[k] : max(begin[k], begin[k + 1] - 1)]).hexdigest())
                columns = [batch.column(0).slice(i, n), pa.array(np.diff(bounds).astype(np.int64)), *(pa.array(c, pa.int64()) for c in top), pa.array(said, pa.string()), pa.array(kept, pa.string())]
                names = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
                if with_runs:
                    rows = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b - a, q)], fields=list(_RUNS.value_type))
                    joined = [text[begin[k] : max(begin[k], begin[k + 1] - 1)].decode() for k in range(n)]
                    columns += [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows, type=_RUNS), pa.array(joined, pa.string())]
                    names += ["runs", "collapsed"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return task


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_runs: bool = False) -> DataFrame:
    """A row for each row of docs: id, n_runs; start, length, period and exponent_milli of the
    run with the most periods; runs_sha256 of all runs; collapsed_sha256 of the text without
    what its runs repeat; with_runs, the runs themselves and the collapsed text.

    A word goes if a run holds it behind its first period; the others are joined by one
    blank. Equal shares of length and period go to the smallest start, then period. Null and
    empty texts have no word and no run: four nulls, and hashes of the empty text. Equal
    texts get equal rows, whatever their ids, null or repeated. Texts are read whole, a very
    long one in a step of its own. An empty table gives no rows; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    more = ", runs array<struct<start: long, length: long, period: long>>, collapsed string" if with_runs else ""
    made = f"n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string{more}"
    return rows.mapInArrow(_runs_task(with_runs), f"id {rows.schema['id'].dataType.simpleString()}, {made}")


def made_periodic(text: Column, id_: Column) -> Column:
    """Every tenth text (by its id's checksum) with its words from some place on repeating a stretch of them.

    A null id changes nothing.
    """
    h = F.crc32(id_.cast("string"))
    g = F.floor(h / 10).cast("long")

    def changed(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        return F.when(n > 0, F.array_join(let(F.struct(a.alias("a"), p.alias("p")), lambda v: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < v["a"], i).otherwise(v["a"] + (i - v["a"]) % v["p"]).cast("int")))), " ")).otherwise(text)

    return F.when(h % 10 == 0, let(words_of(text), changed)).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hurt = docs.select("doc_id", made_periodic(F.col("text"), F.col("doc_id")).alias("text"))
    return periodic_runs(hurt).withColumnRenamed("id", "doc_id")
