"""Substring, near-duplicate and embedding deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowloom.llm import common, embedding_dedup
from flowloom.llm.common import Scratch, components
from flowloom.llm.embedding_dedup import found_links, similar_vectors
from flowloom.llm.hnsw import Graph
from flowloom.llm.minhash_dedup import distinct_documents, estimate, near_duplicates, registers
from flowloom.llm.substring_dedup import cleaned, remove_repeats, sketch

LOW = {c: c + 32 for c in range(65, 91)}


def texts(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé日") for _ in range(r.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    passage, other = prose(50), prose(35)
    out = [None, "", " \t\n ", "one", "One", " ".join(prose(34)), " ".join(other), " ".join(other)]
    for k in range(30):
        base = prose(r.randint(20, 120))
        if k % 3 == 0:
            base[5:5] = passage
        out.append(r.choice([" ", "\n", "  ", "\x0b"]).join(base))
    base = prose(80)
    for _ in range(12):  # near copies
        copy = list(base)
        copy[r.randrange(80)] = word()
        out.append(" ".join(copy).upper() if r.random() < 0.3 else " ".join(copy))
    out += ["of " * 200, "a b c " * 100, " ".join(prose(70)) * 2, "x" * 100_000 + " " + " ".join(passage), "no break space " * 20]
    return out


def brute_repeats(rows, window=35):
    words = [(t or "").encode().split() for t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def test_repeats_match_brute_force(spark):
    rows = texts()
    rows += [rows[9]]  # a repeated row
    ids = [*range(len(rows) - 1), 9]
    df = spark.createDataFrame(list(zip(ids, rows, ["clash"] * len(rows), strict=True)), "doc_id long, text string, n_words string").repartition(3)
    got = remove_repeats(df).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = brute_repeats(rows)
    assert sorted(tuple(r) for r in got) == sorted((i, *w) for i, w in zip(ids, want, strict=True))


@pytest.mark.parametrize("cells", [1 << 16])
def test_repeats_with_a_full_sketch_and_other_windows(spark, cells):
    rows = texts(2)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = remove_repeats(df, window=12, anchor=5, max_cells=cells).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == [(i, *w) for i, w in enumerate(brute_repeats(rows, 12))]


def test_repeats_with_one_anchor_in_very_many_contexts(spark):
    """A common line: the windows around it share an anchor and differ."""
    r = random.Random(8)
    line = [f"c{k}" for k in range(24)]
    own = lambda: [f"x{r.randrange(10**6)}" for _ in range(20)]
    rows = [" ".join([*own(), *line, *own()]) for _ in range(700)]
    rows += [rows[5], rows[6] + " more", *(" ".join([*own(), *line, *line, *own()]) for _ in range(5))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    bits, filled, hot = sketch(df.select("text"))
    assert hot.any() and len(filled) == 2
    got = remove_repeats(df).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(tuple(x) for x in got) == [(i, *w) for i, w in enumerate(brute_repeats(rows))]


def test_any_number_of_hot_anchors_in_a_block_is_dealt_window_by_window(spark):
    """More common lines than a block once had names for: no key keeps HOT rows or more."""
    from flowloom.llm import substring_dedup as D

    r = random.Random(3)
    lines = [[f"l{k}w{i}" for i in range(34)] for k in range(90)]
    own = lambda: [f"x{r.randrange(10**7)}" for _ in range(6)]
    rows = [" ".join(w for line in lines for w in (*own(), *line)) for _ in range(420)] + ["tail " + " ".join(f"t{k}" for k in range(40))] * 2
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string").repartition(4)
    bits, *found = sketch(df.select("text"), max_cells=1 << 16)
    assert int(np.unpackbits(found[1]).sum()) > 80  # the block's hot counters
    keyed = df.select("id", F.hash("text").alias("tag"), "text")
    runs = keyed.mapInArrow(D._query_task(bits, spark.sparkContext.broadcast(found), D.WINDOW, D.ANCHOR), D._RUN)
    assert runs.where("anchor is not null").groupBy("anchor").count().agg(F.max("count")).first()[0] < D.HOT
    got = {x[0]: tuple(x)[1:] for x in remove_repeats(df, "id", max_cells=1 << 16).select("row.id", "n_words", "n_removed", "kept_sha256").collect()}
    want = brute_repeats(rows)
    assert got == dict(enumerate(want)) and got[420][1] == 41 == got[420][0]


def test_repeats_empty_table_and_cleaned_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert remove_repeats(empty).count() == 0
    p = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, p + " tail", 5, "s"), (2, "head " + p, 6, "s"), (3, "a\nb", 3, None), (None, None, None, None)], "doc_id long, text string, n_chars long, kept_text string")
    out = {r["doc_id"]: r for r in cleaned(df).collect()}
    assert cleaned(df).columns == df.columns
    assert (out[1]["text"], out[1]["n_chars"]) == ("tail", 4)
    assert (out[2]["text"], out[3]["text"], out[3]["n_chars"], out[None]["text"]) == ("head", "a\nb", 3, None)


def brute_near(rows, percent=75):
    sets = []
    for t in rows:
        w = (t or "").translate(LOW).encode().split()
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(rows))]


def test_near_duplicates_match_brute_force(spark):
    rows = texts(3) + texts(3)[8:12]
    # a group in a large bucket: many near copies of which some only chain
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    for _ in range(120):
        c = list(base)
        for _ in range(r.randint(0, 3)):
            c[r.randrange(60)] = f"v{r.randrange(1000)}"
        rows.append(" ".join(c))
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(rows)], "doc_id long, text string, component_id int, kept string").repartition(3)
    got = sorted(tuple(x) for x in near_duplicates(df).collect())
    assert got == brute_near(rows)


def test_near_duplicates_empty_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (2, ""), (None, None)], "doc_id long, text string")
    got = sorted((tuple(x) for x in near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (2, 0, 2, True), (None, 0, None, True)], key=repr)


def test_near_duplicates_without_ids_and_with_repeated_ids(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    near = [" ".join(base[:k] + [f"v{k}"] + base[k + 1 :]) for k in range(10)]
    far = " ".join(f"q{r.randrange(999)}" for _ in range(50))
    # near copies without ids reach id 7; id 9 stands for two texts; rows without any id in reach
    df = spark.createDataFrame([(None, near[0]), (None, near[1]), (7, near[2]), (9, near[3]), (9, far), (12, far + " tail"), (None, "x y z"), (None, "x y z")], "doc_id long, text string")
    got = sorted((tuple(x) for x in near_duplicates(df).select("id", "component_id", "kept").collect()), key=repr)
    assert got == sorted([(None, 7, False)] * 2 + [(7, 7, True), (9, 7, False), (9, 7, False), (12, 7, False)] + [(None, None, True)] * 2, key=repr)


def test_distinct_documents_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text + " more"), (None, ""), (None, None), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (4, "own words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x) for x in distinct_documents(df).collect()), key=repr)
    assert len(got) == 5 and [x for x in got if x[1] and x[1].startswith("w0")] and (3, "a b c d e f") in got and (None, "a b c d e f") not in got and (None, None) in got and (None, "") in got
    plain = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other"), (4, None)], "doc_id long, text string")
    assert sorted(x["doc_id"] for x in distinct_documents(plain).collect()) == [1, 3, 4]


def test_joint_estimate_is_near_the_similarity():
    r = np.random.default_rng(1)
    for common, own in ((80, 10), (50, 50), (200, 20)):
        a = r.integers(0, 2**63, common + own).astype(np.uint64)
        b = np.r_[a[:common], r.integers(0, 2**63, own).astype(np.uint64)]
        x, y = (registers(np.sort(v), np.array([0, len(v)]), 1024)[0].astype(int) for v in (a, b))
        n = np.array([float(common + own)])
        got = estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), 1024, n, n)[0]
        assert abs(got - common / (common + 2 * own)) < 0.07


def test_registers_merge_by_the_larger():
    r = np.random.default_rng(2)
    a, b = (np.sort(r.integers(0, 2**63, 50).astype(np.uint64)) for _ in range(2))
    one, two, both = (registers(v, np.array([0, len(v)]), 64)[0] for v in (a, b, np.sort(np.r_[a, b])))
    assert (np.maximum(one, two) == both).all()


@pytest.mark.parametrize("gathered", [1 << 20, 7])
def test_components_of_chains_and_stars(spark, gathered, monkeypatch):
    monkeypatch.setattr(common, "GATHERED", gathered)  # few edges a task: several tasks and rounds
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(k, k) for k in (7, 500)] + [(200 + r.randrange(50), 200 + r.randrange(50)) for _ in range(40)]
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    touched = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: find(v) for v in touched}


def vectors(seed=0):
    r = np.random.default_rng(seed)
    v = r.normal(size=(300, 16)).astype(np.float32)
    for k in range(0, 60):
        v[100 + k] = v[k % 7] + r.normal(size=16).astype(np.float32) * 0.08
    v[200:230] = v[3]
    v[230] = v[4] * 7
    return v


def brute_vectors(rows, cosine=0.95):
    ok = [x is not None and len(x) > 0 and all(c is not None and np.isfinite(c) for c in x) and any(x) for x in rows]
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    wide = [np.array(x, float) if ok[i] else None for i, x in enumerate(rows)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(wide[i]) == len(wide[j]):
                a, b = wide[i], wide[j]
                if a @ b >= cosine * np.sqrt(a @ a) * np.sqrt(b @ b):
                    links[i] += 1
                    links[j] += 1
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return [(i, links[i], find(i), find(i) == i) for i in range(n)]


def test_similar_vectors_match_brute_force(spark):
    rows = [[float(c) for c in x] for x in vectors()] + [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None], [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate(rows)], "vec_id long, embedding array<float>, n_links string").repartition(3)
    got = sorted(tuple(x) for x in similar_vectors(df, shards=3).collect())
    rows32 = [None if x is None else [None if c is None else np.float32(c) for c in x] for x in rows]
    assert got == brute_vectors(rows32)
    assert similar_vectors(df.where("false")).count() == 0


def test_similar_vectors_without_ids_and_wide_ones(spark):
    r = np.random.default_rng(7)
    wide = r.normal(size=(12, 700)).astype(np.float32)
    wide[6:] = wide[:6] + r.normal(size=(6, 700)).astype(np.float32) * 0.05
    rows = [(k if k < 6 else None, [float(c) for c in x]) for k, x in enumerate(wide)] + [(None, [1.0, 0.0]), (None, [1.0, 0.01]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(x) for x in similar_vectors(df, shard_bytes=1 << 15).collect()), key=repr)  # five vectors a shard
    assert got == sorted([(k, 1, k, True) for k in range(6)] + [(None, 1, k, False) for k in range(6)] + [(None, 1, None, True)] * 2 + [(None, 0, None, True)], key=repr)


@pytest.mark.parametrize("pairs", [1 << 25, 10])
@pytest.mark.parametrize("same", [True, False])
def test_two_shards_meet(pairs, same, monkeypatch):
    """Searches, and blocks where there are too many links to hold."""
    monkeypatch.setattr(embedding_dedup, "PAIRS", pairs)
    v = vectors(2)
    v[150:290] = v[3] + np.random.default_rng(1).normal(size=(140, 16)).astype(np.float32) * 0.02
    rep = np.random.default_rng(4).permutation(300)
    half = np.zeros(300, int) if same else np.arange(300) % 2
    shards = []
    for k in range(1 if same else 2):
        at = np.flatnonzero(half == k)
        t = {"dim": [16] * len(at), "shard": [k] * len(at), "rep": rep[at], "rows": np.full(len(at), 2), "vector": pa.array([x.tolist() for x in v[at]], pa.list_(pa.float32()))}
        shards.append(embedding_dedup._build(pa.table(t)))
    both = pa.concat_tables(shards)
    both = both.append_column("p", pa.array([0] * len(both))).append_column("q", pa.array([0 if same else 1] * len(both)))
    got = embedding_dedup._meet(0.95)(both).to_pydict()
    w = v.astype(float)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    link = (w @ w.T >= 0.95) & ~np.eye(300, dtype=bool) & (same | (half[:, None] != half[None, :]))
    assert dict(zip(got["id"], got["n"], strict=True)) == {int(rep[i]): int(2 * link[i].sum()) for i in range(300) if link[i].any()}
    a, b = common.forest(*(rep[x].astype(np.int64) for x in np.nonzero(link)))
    root = dict(zip(a.tolist(), b.tolist(), strict=True))
    assert dict(zip(got["id"], got["root"], strict=True)) == {i: root.get(i, i) for i in got["id"]}


@pytest.mark.parametrize("cut", ["one point", "all"])
def test_links_that_the_graph_misses_are_found(cut):
    """Rare links, and links of points that can't be reached."""
    r = np.random.default_rng(5)
    v = r.normal(size=(600, 24)).astype(np.float32)
    near = np.arange(1, 600, 2) if cut == "all" else np.array([301])
    v[near] = v[near - 1] + r.normal(size=(len(near), 24)).astype(np.float32) * 0.02
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = Graph.build(v)
    lost = np.isin(g.base, near)
    g = Graph(v, np.where(lost, -1, g.base), [])
    q, p = found_links(g, v, 0.95)
    want = {(a, b) for k in near.tolist() for a, b in ((k - 1, k), (k, k - 1))}
    assert {(a, b) for a, b in zip(q.tolist(), p.tolist(), strict=True) if a != b} == want


@pytest.mark.parametrize("links", [0, 20, 1500])
def test_links_come_from_the_graph_whatever_their_number(links, monkeypatch):
    """All queries search the graph, a bounded audit compares, and hardly a link is missed."""
    r = np.random.default_rng(links)
    v = r.normal(size=(3000, 32)).astype(np.float32)
    for k in range(links):
        v[3000 - links + k] = v[k % 700] + r.normal(size=32).astype(np.float32) * 0.1
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph, searched, compared = Graph.build(v), [], []
    search, compare = Graph.search, embedding_dedup._compared
    monkeypatch.setattr(Graph, "search", lambda self, q, beam, limit=None: searched.append(len(q)) or search(self, q, beam, limit))
    monkeypatch.setattr(embedding_dedup, "_compared", lambda a, b, near: compared.append(len(a) * len(b)) or compare(a, b, near))
    q, p = found_links(graph, v, 0.95)
    assert sum(searched) >= 3000 and sum(compared) <= (embedding_dedup.AUDITED + 30) * 3000
    want = {(i, j) for i, j in zip(*np.nonzero(v @ v.T >= 0.95), strict=True) if i != j}
    got = set(zip(q.tolist(), p.tolist(), strict=True))
    assert len(want & got) >= 0.99 * len(want) and (links == 0) == (not want)


def test_planted_queries_are_just_above_the_limit():
    r = np.random.default_rng(2)
    v = r.normal(size=(50, 8))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    point, turned = embedding_dedup.planted(v, 200, 0.95, r)
    c = np.einsum("kd,kd->k", v[point].astype(float), turned.astype(float))
    assert (c >= 0.95).all() and (c < 0.9706).all() and np.allclose(np.linalg.norm(turned, axis=1), 1, atol=1e-5)
    one = np.array([[1.0], [-1.0]], np.float32)
    point, turned = embedding_dedup.planted(one, 5, 0.95, r)
    assert (turned == one[point]).all()


def test_graph_recall():
    r = np.random.default_rng(3)
    v = r.normal(size=(1500, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, sims = Graph.build(v).search(v[:200], 48)
    true = np.argsort(-(v[:200] @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true, strict=True)]) > 0.9
    assert (np.diff(sims, axis=1) <= 0).all()


def test_large_mixed_buckets_are_compared_in_blocks(spark):
    """Groups around bases that are near each other: stars leave several components in wide buckets."""
    r = random.Random(31)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for _ in range(220):
        c = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5])):
            c[r.randrange(120)] = f"v{r.randrange(10**6)}"
        rows.append(" ".join(c))
    r.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert sorted(tuple(x) for x in near_duplicates(df).collect()) == brute_near(rows)


@pytest.mark.parametrize("cut", [1, 40])
def test_block_task_finds_all_links_between_components(cut):
    from flowloom.llm import minhash_dedup as N

    r = np.random.default_rng(9)
    base = r.integers(0, 2**62, 100).astype(np.uint64)
    sets = [np.sort(np.r_[base[: 100 - k], r.integers(0, 2**62, k).astype(np.uint64)]) for k in r.integers(0, 12, 60)]
    regs = [N.registers(s, np.array([0, len(s)]), 8)[0] for s in sets]
    regs = [regs[0]] * 60  # all in one bucket
    comp = np.where(np.arange(60) < cut, 0, np.arange(60))
    band = int(N.band_keys(np.stack(regs[:1]), 2).view(np.int64)[0, 0])
    side = [1] * 60 + [0] * (60 - cut)
    at = [*range(60), *range(cut, 60)]
    t = pa.table({
        "band": [band] * len(at), "side": side, "comp": comp[at], "n": [100] * len(at), "regs": [regs[k].tobytes() for k in at], "set": [sets[k].tobytes() for k in at],
    })
    got = N._block_task(75, 2)(t).to_pydict()
    links = {(int(comp[i]), int(comp[j])) for i in range(cut, 60) for j in range(60) if comp[i] != comp[j] and 400 * len(np.intersect1d(sets[i], sets[j])) >= 300 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(got["a"], got["b"], strict=True)) == links
