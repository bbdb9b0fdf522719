"""Toxicity by multiple-instance learning."""

import random
import re
import zlib

import numpy as np

from flowloom.llm import toxicity as T

TOP = 2**64


def mixed(x, seed):
    x = (x + seed * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) % TOP
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % TOP
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % TOP
    return x ^ (x >> 31)


def plain_features(sentence):
    """The distinct features of a sentence, word by word."""
    out = set()
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", sentence.encode().lower()):
        for k in (0, *T.BEGINNINGS):
            if k == 0 or len(w) > k:
                part = w[: k or None]
                h = sum((c + 1) * pow(0x9E3779B97F4A7C15, i, TOP) for i, c in enumerate(part)) % TOP
                out.add(mixed(h, 41 + k) >> (64 - T.BITS))
    return out


def plain_score(text, weights):
    none, n = 1.0, 0
    for sentence in re.split(r"[.!?\n]", text):
        features = plain_features(sentence)
        if features:
            n += 1
            none *= 1 - 1 / (1 + np.exp(-(weights[-1] + sum(weights[f] for f in features))))
    return 1 - none, n


def odd_texts():
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcXYZ019é日-,.$!\n") for _ in range(r.randint(1, 9)))
    return ["", "a", " lead  and\ttabs ", "Same same SAME same. Same!", "é", "...", "?!\n", "no end", *(" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(80))]


def test_scores_match_a_plain_version_whatever_stands_beside(spark):
    weights = (np.random.default_rng(6).normal(size=(1 << T.BITS) + 1) * 0.3).astype(np.float32)
    weights[: 1 << 16] = 0
    rows = odd_texts()
    kind = "id long, held_out boolean, score double, n_sentences long, offending array<struct<start: long, end: long, score: double>>"
    task = T._score_task(spark.sparkContext.broadcast(weights), 0.5)
    df = spark.createDataFrame([(i, False, t) for i, t in enumerate(rows)], "id long, held_out boolean, text string")
    together = {r["id"]: r for r in df.coalesce(1).mapInArrow(task, kind).collect()}
    alone = {r["id"]: r for r in df.repartition(len(rows), "id").mapInArrow(task, kind).collect()}
    assert together == alone
    for i, t in enumerate(rows):
        score, n = plain_score(t, weights.astype(float))
        assert abs(together[i]["score"] - score) < 1e-9 and together[i]["n_sentences"] == n
        for s in together[i]["offending"]:
            said = t[s["start"] : s["end"]]
            assert not re.search(r"[.!?\n]", said) and said and abs(plain_score(said, weights.astype(float))[0] - s["score"]) < 1e-9
        assert bool(together[i]["offending"]) == (together[i]["score"] >= 0.5)


def test_blame_is_the_derivative_of_the_noisy_or_loss():
    r = np.random.default_rng(3)
    for label in (0, 1):
        m = r.normal(size=5)

        def loss(x, label=label):
            none = np.exp(-np.logaddexp(0, x).sum())
            return -np.log(none if label == 0 else 1 - none)

        for k in range(5):
            d = np.zeros(5)
            d[k] = 1e-6
            assert abs((loss(m + d) - loss(m - d)) / 2e-6 - T.blame(m, label)[k]) < 1e-6


def made_documents(n, seed):
    """Documents of several sentences; a toxic one has one sentence with an insult."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    out = []
    for i in range(n):
        sentences = [" ".join(word() for _ in range(r.randint(3, 9))) for _ in range(r.randint(2, 12))]
        toxic = int(r.random() < 0.25)
        if toxic:
            sentences[r.randrange(len(sentences))] += f" you {r.choice(['wretch', 'blockhead', 'vermin'])}{r.choice(['', 's', 'ly'])}"
        out.append((i, ". ".join(sentences) + ".", toxic))
    return out


def test_held_out_documents_and_their_sentences_are_found(spark):
    rows = made_documents(1500, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = T.toxicity_scores(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in out)
    at = {i: (t, y) for i, t, y in rows}
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] != at[r["id"]][1] for r in held) <= 2
    right = [r for r in held if r["predicted"] and at[r["id"]][1]]
    assert len(right) > 50
    for r in right:
        text = at[r["id"]][0]
        assert any(re.search("wretch|blockhead|vermin", text[s["start"] : s["end"]]) for s in r["offending"])
        assert len(r["offending"]) <= 2


def test_edge_cases(spark):
    rows = [(1, None, 9.0), (2, "", 9.0), (3, "...!", 9.0), (None, "you fool", 9.0), (5, "fool " * 30_000, 9.0), (5, "fool " * 30_000, 9.0), (6, "kind words. more of them", 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(5, 1, 7), (5, 1, 7), (6, 0, 7), (1, 1, 7), (2, None, 7), (None, 1, 7), (99, 1, 7)], "doc_id long, toxic int, score int")
    out = T.toxicity_scores(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert {r["score"] for r in out if r["id"] in (1, 2, 3)} == {0.0}
    assert len({(r["score"], r["n_sentences"]) for r in out if r["id"] == 5}) == 1
    assert T.toxicity_scores(docs.where("false"), labels).count() == 0
    assert {r["score"] for r in T.toxicity_scores(docs, labels.where("false")).collect()} == {0.0}
    # an id with both labels isn't learned from
    both = labels.union(spark.createDataFrame([(5, 0, 7)], labels.schema))
    assert np.array_equal(T.fit(docs, both), T.fit(docs, labels.where("doc_id is null or doc_id <> 5")))


def test_sums_of_texts_don_t_depend_on_neighbours():
    from flowloom.llm.linear_text import text_sums

    r = np.random.default_rng(1)
    parts = [r.normal(size=n) for n in r.integers(0, 300, 60)]
    first = np.r_[0, np.cumsum([len(p) for p in parts])]
    together = text_sums(np.concatenate(parts), first)
    assert all(text_sums(p, np.array([0, len(p)]))[0] == together[i] for i, p in enumerate(parts))
    assert text_sums(np.empty(0), np.array([0, 0])).tolist() == [0.0] and len(text_sums(np.empty(0), np.array([0]))) == 0


def test_quality_and_language_scores_are_equal_alone_and_in_company(spark):
    from flowloom.llm import quality_model as Q

    weights = np.random.default_rng(6).normal(size=(1 << Q.BITS) + 1).astype(np.float32)
    rows = odd_texts()
    df = spark.createDataFrame([(i, False, t) for i, t in enumerate(rows)], "id long, held_out boolean, text string")
    task = Q._score_task(spark.sparkContext.broadcast(weights))
    kind = "id long, held_out boolean, score double"
    assert {tuple(r) for r in df.coalesce(1).mapInArrow(task, kind).collect()} == {tuple(r) for r in df.repartition(len(rows), "id").mapInArrow(task, kind).collect()}
