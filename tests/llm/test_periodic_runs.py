"""Periodic runs against a search of all periods at all places."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from flowloom.llm import periodic_runs as P


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(w):
    """(start, length, period) of every run: maximal stretches of each period, smallest period only."""
    n, spans = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                spans.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in spans.items())


def plain(text):
    w = words(text)
    runs = plain_runs(w)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return len(runs), *four, hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def some_texts(seed, n, longest=160):
    r = random.Random(seed)
    out = [None, "", " \n ", "a", "a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b", "x " * 1000, "a b c " * 200 + "d " + "a b c " * 40, "é 日 " * 9, "a a a a a a b " * 12]
    for _ in range(n):
        w = []
        while len(w) < r.randint(1, longest):
            unit = [r.choice("abcd" if r.random() < 0.7 else "ab") for _ in range(r.randint(1, 12))]
            w += unit * r.choice([1, 1, 2, 3, 4, 5, 7]) + unit[: r.randint(0, len(unit))]
        out.append(r.choice([" ", "\n", " \t"]).join(w))
    return out


def test_runs_match_all_periods_at_all_places(spark):
    rows = some_texts(3, 400)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, start string").coalesce(2)
    got = P.periodic_runs(df, with_runs=True).collect()
    assert {r["id"]: tuple(r[c] for c in COLUMNS) for r in got} == {i: plain(t) for i, t in enumerate(rows)}
    for r in got:
        assert [tuple(x) for x in r["runs"]] == plain_runs(words(rows[r["id"]]))
        assert hashlib.sha256(r["collapsed"].encode()).hexdigest() == r["collapsed_sha256"]


@pytest.mark.parametrize("size", [3, 64])
def test_small_steps_give_the_same_runs(monkeypatch, size):
    rows = [words(t) for t in some_texts(8, 60)]
    codes = np.array([hash(x) % 2**63 for w in rows for x in w], np.uint64)
    first = np.r_[0, np.cumsum([len(w) for w in rows])]
    want = [(i, a, a + n, q) for i, w in enumerate(rows) for a, n, q in plain_runs(w)]
    monkeypatch.setattr(P, "PAIRS", size)
    assert list(zip(*(x.tolist() for x in P.runs_of(codes, first)), strict=True)) == want


def test_words_outside_repeated_grams_are_masked():
    w = np.array([1, 2, 3, 4, 5, 6, 9, 1, 2, 3, 4, 5, 8, 7, 7, 7, 7, 7, 7], np.uint64)
    a, b = P.surviving(w, np.zeros(len(w), int))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(13, 19)]  # the two copies of 1 to 5 are shorter than a run
    # what repeats in another text only doesn't count
    assert not len(P.surviving(np.r_[w[:6], w[:6]], np.repeat([0, 1], 6))[0])
    long = np.r_[np.arange(40), np.arange(40)].astype(np.uint64)
    a, b = P.surviving(long, np.zeros(80, int))
    assert (a.tolist(), b.tolist()) == ([0], [80]) and not len(P.main_lorentz(long, a, b)[0])


def test_long_texts_and_edge_cases(spark):
    r = random.Random(4)
    unit = [f"w{r.randint(0, 500)}" for _ in range(3000)]
    long = " ".join([f"v{k}" for k in range(5000)] + unit * 5 + unit[:17] + ["end"])
    rows = [(1, long), (1, long), (None, "a b " * 30_000), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.periodic_runs(df).collect()
    ones = [tuple(x[c] for c in COLUMNS[:5]) for x in got if x["id"] == 1]
    start = 5000
    assert len(ones) == 2 and ones[0] == ones[1] and ones[0][1:4] == (start, 15_017, 3000)
    (two,) = [x for x in got if x["id"] is None]
    assert (two["n_runs"], two["length"], two["period"]) == (1, 60_000, 2) and two["collapsed_sha256"] == hashlib.sha256(b"a b").hexdigest()
    assert P.periodic_runs(df.where("false")).count() == 0


def test_query_equals_a_plain_version(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()

    def hurt(i, text):
        h, w = zlib.crc32(str(i).encode()), words(text)
        if h % 10 or not w:
            return text
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))

    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in P.op13_periodic_runs(spark, d).collect()}
    small = [r for r in docs if len(words(r["text"])) < 3000]
    assert len(got) == len(docs) and sum(zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in small) > 5
    assert {r["doc_id"]: got[r["doc_id"]] for r in small} == {r["doc_id"]: plain(hurt(*r)) for r in small}
    odd = spark.createDataFrame([(4, None), (4, ""), (None, "a b c")], "doc_id long, text string")
    kept = odd.select(P.made_periodic(odd["text"], odd["doc_id"]).alias("t")).collect()
    assert [r["t"] for r in kept] == [None, "", "a b c"]
