"""Language ID, quality model, quality rules and SentencePiece."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import sentencepiece as S
from flowloom.llm.language_id import family_of, fit_pair, identify
from flowloom.llm.quality_model import Ftrl, quality_scores
from flowloom.llm.quality_rules import MEASURES, RULES, fit, good_documents, judged, label_model, measures

DATA = "/root/testdata/sf0.001"


def plain_measures(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, double = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            double += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), double, len(covered)


def test_quality_measures_match_plain_version(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abé日#*|") for _ in range(r.randint(1, 3)))
    rows = [None, "", " ", "\n\n", "a", "a b c", "a b c a b c", "a a a a", "x\ny\nx\nx", " x\nx ", "a b\n\n\na b\n", "of " * 300, "é" * 5000]
    rows += [r.choice([" ", "\n"]).join(word() for _ in range(r.randint(0, 80))) for _ in range(60)]
    rows += rows[:2]
    df = spark.createDataFrame([(i, t, 1, True) for i, t in enumerate(rows)], "doc_id long, text string, n_words int, kept boolean")
    got = {x["doc_id"]: tuple(x[c] for c in MEASURES) for x in judged(df).select("row.doc_id", *MEASURES).collect()}
    assert got == {i: plain_measures(t) for i, t in enumerate(rows)}
    assert good_documents(df).columns == df.columns
    assert judged(df.where("false")).count() == 0


def test_base_rule_and_posterior_decide(spark):
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))
    good = [prose(r.randint(60, 200)) for _ in range(80)]
    bad = [re.sub(" ", "$$$ ", prose(90)) for _ in range(6)] + [prose(90).upper() for _ in range(6)]
    short, loop = ["a few words"], ["same same again " * 40]
    rows = good + bad + short + loop
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {x["doc_id"]: x for x in judged(df).select("row.doc_id", "base_failed", "kept", "quality").collect()}
    assert all(out[i]["kept"] for i in range(80))
    assert not any(out[i]["kept"] or out[i]["base_failed"] for i in range(80, 92))
    assert out[92]["base_failed"] and out[93]["base_failed"]
    # the expression equals the model evaluated by hand
    model = label_model(measures(df))
    assert 0.5 < model.prior < 1 and len(model.log_odds) == len(RULES)


def test_label_model_finds_accuracies():
    r = random.Random(8)
    seen = Counter()
    for _ in range(4000):
        good = r.random() < 0.8
        vote = tuple(
            (0 if r.random() < (0.02 if good else 0.5) else (1 if r.random() < (0.7 if good else 0.2) else None)) for _ in range(4)
        )
        seen[vote] += 1
    model = fit(list(seen.items()), 4)
    assert abs(model.prior - 0.8) < 0.05
    assert all(bad < -1.5 and better > 0 for bad, better, _ in model.log_odds)


def test_languages_are_held_out_and_predicted(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = identify(docs).withColumnRenamed("id", "doc_id").join(docs, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_languages_edge_cases(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "123 !!", None, 1), (None, "the and with", None, 1), (5, "the and with the of" * 2000, "en", 1), (6, "und der die das mit", "de", 1), (6, "und der die das mit", "de", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = [(r["id"], r["lang_pred"], r["score"]) for r in identify(df).collect()]
    assert len(got) == len(rows) and {(i, p) for i, p, _ in got if i in (1, 2, 3)} == {(1, "und"), (2, "und"), (3, "und")}
    assert identify(df.where("false")).count() == 0
    assert {r["lang_pred"] for r in identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert family_of("en") == family_of("de") != family_of("fr") and family_of("zz") == "zz"


def test_pair_machine_separates():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 10)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1, -1).astype(np.float32)
    w = fit_pair(x, y)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.95


def test_quality_scores_are_held_out_and_separate(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality_scores(docs, labels).withColumnRenamed("id", "doc_id").join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    good, bad = ([r["score"] for r in out if r["held_out"] and r["quality"] == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in out)


def test_quality_scores_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (None, "a b", 3.0), (4, "Word!! " * 20_000, 3.0), (4, "Word!! " * 20_000, 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (9, 1), (2, None), (None, 1)], "doc_id long, quality int")
    out = quality_scores(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert quality_scores(docs.where("false"), labels).count() == 0
    assert {r["score"] for r in quality_scores(docs, labels.where("false")).collect()} == {0.5}


def test_ftrl_learns_sparse_weights():
    r = np.random.default_rng(2)
    m = Ftrl(50, l1=0.5)
    for _ in range(3000):
        at = r.choice(50, 5, replace=False)
        m.learn(np.append(at, 50), np.ones(6), int(3 in at), 1.0)
    w = m.weights()
    assert w[3] == w[:-1].max() and w[3] > 2 and (np.abs(np.delete(w[:-1], 3)) < 1.5).all()


@pytest.fixture(scope="module")
def vocabulary():
    return S.load()


def library(model_type=None):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=S.MODEL)


def ids(v, text):
    return np.frombuffer(v.encode(text), np.int32).tolist()


def test_encoding_equals_the_public_library(vocabulary):
    sp, r = library(), random.Random(3)
    alphabet = "abcdeEt ,.  é日本\n\t😀▁-_'1290thinger½²"
    rows = ["", " ", "a", "the " * 3000, "the" * 3000 + "x" * 5000, "日" * 4000] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    assert [ids(vocabulary, t) for t in rows] == sp.encode(rows)


def test_decoding_round_trips_and_equals_the_library(vocabulary):
    sp, r = library(), random.Random(4)
    for t in ["", "a", " a", "tab\tand\nline", "日本語 text", "\x00", "é ½"]:
        assert vocabulary.decode(ids(vocabulary, t)) == t
    for _ in range(300):
        some = [r.randrange(3, 32000) for _ in range(r.randint(0, 12))]
        assert vocabulary.decode(some) == sp.decode(some)


def test_streaming_commits_equal_a_whole_search(vocabulary):
    """Without stretches, so that paths stay open over long texts; also a unigram lattice."""
    r = random.Random(5)
    for _ in range(5):
        t = "".join(r.choice("abcdefghijklmnoprstuwyaeiouth") for _ in range(2500))
        assert list(vocabulary.search(t)) == vocabulary.merged(t)
    pieces = ["a", "b", "ab", "ba", "aba", "bab", "abba"]
    uni = S.Vocabulary({p: i for i, p in enumerate(pieces)}, {p: -1.0 - 0.37 * i for i, p in enumerate(pieces)}, pieces, {}, 99, False)
    for _ in range(30):
        t = "".join(r.choice("abc") for _ in range(300))
        best = {0: (0.0, ())}
        for k in range(1, len(t) + 1):
            best[k] = max((best[j][0] + uni.scores.get(t[j:k], uni.floor), (*best[j][1], t[j:k])) for j in range(max(0, k - 4), k) if t[j:k] in uni.scores or k == j + 1)
        got = list(uni.search(t))
        cost = lambda ps: sum(uni.scores.get(p, uni.floor) for p in ps)
        assert "".join(got) == t and abs(cost(got) - best[len(t)][0]) < 1e-6


def test_encoding_tables(spark):
    rows = [(1, None, [1]), (2, "", None), (3, "Some text, twice.", None), (3, "Some text, twice.", None), (None, "x" * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    out = S.encoded(df, check=True)
    got = out.collect()
    assert [r["n_tokens"] for r in got if r["id"] in (1, 2)] == [0, 0] and all(r["round_trip"] for r in got)
    back = {(r["id"], r["text"]) for r in S.decoded(out).collect()}
    assert back == {(i, t or "") for i, t, _ in rows}
    assert S.encoded(df.where("false")).count() == 0


def test_blocks_of_any_size_give_the_same_ids(vocabulary, monkeypatch):
    r = random.Random(3)
    rows = ["", " lead", "a  b   c ", "x" * 500, "word, word; word.", "é日本 語, done", "\n\ttabs and\nlines ", " ".join("".join(r.choice("abcdéz,.") for _ in range(r.randint(1, 30))) for _ in range(80)), ""]
    raw = [t.encode() for t in rows]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = [i for t in library().encode(rows) for i in t]
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(S, "BLOCK", size)
        values, count = vocabulary.encode_many(data, offsets)
        assert values.tolist() == want and count.tolist() == [len(x) for x in library().encode(rows)]
        assert vocabulary.round_trips(data, offsets, values, count).all()


def test_samples_are_bounded_and_settled(spark):
    from flowloom.llm.linear_text import bounded_sample

    rows = [(k % 4, k) for k in range(4000)] + [(9, 1)] * 500 + [(None, 2)] + [(100 + k, 5) for k in range(90)]
    df = spark.createDataFrame(rows, "by int, key long").withColumn("text", F.col("key").cast("string"))
    got = bounded_sample(df, "by", 100, "key", values=5).collect()
    assert {r["by"] for r in got} <= {0, 1, 2, 3, 9} and len(got) < 600 and sum(r["by"] == 9 for r in got) <= 1


def test_an_id_with_both_labels_is_not_learned_from(spark):
    from flowloom.llm.quality_model import fit

    docs = spark.createDataFrame([(1, "good words here"), (2, "bad $$ ##"), (3, "both of them"), (3, "both of them")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0), (1, 1)], "doc_id long, quality int")
    plain = fit(docs.where("doc_id < 3"), labels.where("doc_id < 3"))
    assert np.array_equal(fit(docs, labels), plain) and np.array_equal(fit(docs.repartition(3), labels.repartition(2)), plain)


def odd_texts():
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcXYZ019é日-,.$") for _ in range(r.randint(1, 9)))
    return ["", "a", " lead  and\ttabs ", "Same same SAME same", "é", *(r.choice([" ", "\n"]).join(word() for _ in range(r.randint(1, 60))) for _ in range(60))]


def test_language_scores_match_a_plain_version(spark):
    from flowloom.llm import language_id as L

    rng = np.random.default_rng(5)
    languages, families = ("de", "en", "es", "fr"), ("germanic", "romance")
    pairs = ((True, 0, 1), (False, 0, 1), (False, 2, 3))
    weights = rng.normal(size=(3, (2 << L.BITS) + 1)).astype(np.float32) * 0.1
    model = L.LanguageModel(languages, families, pairs, weights)

    def plain(text):
        b = [ord(" ") if c < 128 and not chr(c).isalpha() else c + 32 if 65 <= c <= 90 else c for c in text.encode()] + [32, 32]
        margins = []
        for w in weights.astype(float):
            total = 0.0
            for i in range(len(b) - 2):
                two = (b[i] * 0x9E3779B1 + b[i + 1] * 0x85EBCA6B) % 2**32
                three = (two + b[i + 2] * 0xC2B2AE35) % 2**32
                at = [(((x ^ (x >> 15)) * 0x2C1B3C6D) % 2**32) >> (32 - L.BITS) for x in (two, three)]
                total += w[at[0]] + w[(1 << L.BITS) + at[1]]
            margins.append(w[-1] + 100 / max(len(b) - 2, 1) * total)
        chance = [1 / (1 + np.exp(-4 * m)) for m in margins]
        family, p = (0, chance[0]) if chance[0] > 0.5 else (1, 1 - chance[0])
        k = 1 + family
        lang, q = (2 * family, chance[k]) if chance[k] > 0.5 else (2 * family + 1, 1 - chance[k])
        return languages[lang], p * q

    rows = odd_texts()
    df = spark.createDataFrame([(i, False, t, True) for i, t in enumerate(rows)], "id long, held_out boolean, text string, letters boolean").coalesce(1)
    got = df.mapInArrow(L._predict_task(spark.sparkContext.broadcast(model)), "id long, held_out boolean, lang_pred string, score double").collect()
    for r in got:
        lang, score = plain(rows[r["id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4


def test_quality_scores_match_a_plain_version(spark):
    from flowloom.llm import quality_model as Q

    weights = np.random.default_rng(6).normal(size=(1 << Q.BITS) + 1).astype(np.float32)
    top = 2**64

    def mixed(x, seed=0):
        x = (x + seed * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) % top
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % top
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % top
        return x ^ (x >> 31)

    def hashed(values, seed=0):
        return mixed(sum((v + 1) * pow(0x9E3779B97F4A7C15, i, top) for i, v in enumerate(values)) % top, seed)

    def kind(c):
        return 97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c

    def plain(text):
        words, total, last, shape_last = text.encode().split(), 0.0, 0, 0
        for w in words:
            kinds = [kind(c) for c in w]
            shape = hashed([k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k], 5)
            h = hashed(w)
            grams = (h, mixed(last, 1) ^ h, shape, mixed(shape_last, 2) ^ shape, int(last == h))
            total += sum(float(weights[mixed(x, 31 + k) >> (64 - Q.BITS)]) for k, x in enumerate(grams))
            last, shape_last = h, shape
        return 1 / (1 + np.exp(-(float(weights[-1]) + total / max(len(words), 1))))

    rows = odd_texts()
    df = spark.createDataFrame([(i, False, t) for i, t in enumerate(rows)], "id long, held_out boolean, text string").coalesce(1)
    got = df.mapInArrow(Q._score_task(spark.sparkContext.broadcast(weights)), "id long, held_out boolean, score double").collect()
    assert all(abs(r["score"] - plain(rows[r["id"]])) < 1e-6 for r in got)
