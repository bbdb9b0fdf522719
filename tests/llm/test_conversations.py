"""Conversation repair against a search over all edit strings, and its table's odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import conversations as C

FORM = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, lines) of the cheapest edits, ties by audit: all strings, shortest cost first.

    rows: (role, text, must go, cut). Works on whole outputs, not on states.
    """
    import heapq

    todo, seen = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, said, lines = heapq.heappop(todo)
        if i == len(rows) and FORM.fullmatch(said):
            return cost, audit, lines
        key = (i, "u" if said.endswith("u") else "a" if said.endswith("a") else said)
        if (key, audit) in seen or len(said) > len(rows) + 4:
            continue
        seen.add((key, audit))
        for name in ("user", "assistant"):
            if re.match(r"s?(ua)*u?\Z", said + name[0]):
                heapq.heappush(todo, (cost + 2, audit + "I", i, said + name[0], (*lines, f"{name}:")))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(todo, (cost + 3, audit + "D", i + 1, said, lines))
            if not gone:
                if role and re.match(r"s?(ua)*u?\Z", said + role[:1]):
                    heapq.heappush(todo, (cost + cut, audit + "K", i + 1, said + role[:1], (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if re.match(r"s?(ua)*u?\Z", said + name[0]):
                        heapq.heappush(todo, (cost + 2 + cut, audit + "R", i + 1, said + name[0], (*lines, f"{name}:{text}")))


def plain(turns):
    """The row of a conversation: (turn, role, text) in order."""
    seen, rows, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        if fault:
            n[fault] += 1
        seen.add((role, text))
        rows.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    cost, audit, lines = cheapest(rows)
    numbers = [t for t, *_ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def made(seed, n, longest=7):
    r = random.Random(seed)
    out = {}
    for c in range(n):
        turns, at = [], r.choice([None, 0, 3])
        for _ in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "ux"])
            turns.append((at, role, r.choice(["Yes.", "no", "", " \n", "One? ", f"t{r.randint(0, 99)}.", "é!\t"])))
            at = r.randint(0, 2) if at is None else at + r.choice([1, 1, 1, 2, 4])
        out[c] = turns
    return out


def test_repairs_are_the_cheapest_of_all(spark):
    data = made(1, 150)
    rows = [(c, t, role, text) for c, turns in data.items() for t, role, text in turns]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["id"]: tuple(r[c] for c in COLUMNS) for r in C.repaired(df).collect()}
    assert got == {c: plain(t) for c, t in data.items()}
    # the rows themselves are the text that was digested
    lines = {}
    for r in sorted(C.repaired_turns(df).collect(), key=lambda r: (r["id"], r["place"])):
        lines.setdefault(r["id"], []).append(f"{r['role']}:{r['text']}")
        assert r["edit"] in "KRI" and len(lines[r["id"]]) == r["place"] + 1
    for c in data:
        assert hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == got[c][-1]


def test_batches_cut_conversations_anywhere(spark, monkeypatch):
    data = made(5, 60)
    rows = [(c, t, role, text) for c, turns in data.items() for t, role, text in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        monkeypatch.setattr(C, "TURNS", 5)
        monkeypatch.setattr(C, "ROWS", 2)
        got = {r["id"]: tuple(r[c] for c in COLUMNS) for r in C.repaired(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {c: plain(t) for c, t in data.items()}


def test_one_long_conversation_and_edge_cases(spark):
    r = random.Random(9)
    long = [(k, r.choice(["user", "assistant"]), f"turn {k}{r.choice(['.', ''])}") for k in range(20_000)]
    rows = [(1, *t, "x") for t in long]
    rows += [(2, None, None, None, "x"), (None, None, "user", "Hello.", "x"), (None, 1, "assistant", "Yes.", "x"), (3, 1, "user", "Same.", "x"), (3, 1, "user", "Same.", "x"), (4, 1, "user", "é " * 100_000 + ".", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string")
    got = {r["id"]: r for r in C.repaired(df).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    length = got[1]["audit"].replace("I", "")
    assert len(length) == 20_000 and got[1]["gaps"] == 0
    cost = {"K": 0, "I": 2, "R": 2, "D": 3}
    stays = [k for k, e in enumerate(length) if e != "D"]
    assert got[1]["cost"] == sum(cost[e] for e in got[1]["audit"]) + sum(not long[k][2].endswith(".") for k in stays)
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[2]["blank"], got[2]["cost"], got[2]["audit"], got[2]["repaired_sha256"]) == (1, 3, "D", empty)
    assert (got[None]["cost"], got[None]["audit"], got[None]["gaps"]) == (0, "KK", 0)
    assert (got[3]["duplicate"], got[3]["cost"], got[3]["audit"]) == (1, 5, "KDI")
    assert got[4]["audit"] == "KI"
    assert C.repaired(df.where("false")).count() == 0 and C.repaired_turns(df.where("false")).count() == 0
    gone = {r["id"]: r for r in C.repaired(df, present=F.col("conv_id") == 3).collect()}
    assert set(gone) == set(got) and (gone[1]["cost"], gone[1]["audit"], gone[1]["repaired_sha256"], gone[1]["gaps"]) == (0, "", empty, 0)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '/root/testdata/{sf}/conversations.parquet'")
    want = con.execute(C.OP11_SQL)
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in names) for r in C.op11_conversation_repair(spark, f"/root/testdata/{sf}").collect()) == sorted(want.fetchall())


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "A. b!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    out, left = C.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {}
    for r in out.where(left).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = [("user" if d == 4 else role or " ", "" if d == 1 else re.sub("[.!?]", "", text or " ") if d == 2 else text or " ")] * (0 if d == 0 else 2 if d == 3 else 1)
        assert got.get((c, t), []) == want


def test_costs_are_those_of_a_plain_recursion():
    r = np.random.default_rng(4)
    n = r.integers(0, 9, 40)
    first = np.r_[0, np.cumsum(n)]
    code, bad = r.integers(0, 4, first[-1]).astype(np.uint8), r.random(first[-1]) < 0.2
    total, audits = C.edits(code, bad, first)
    roles = ("system", "user", "assistant", "x")
    for i in range(len(n)):
        own = slice(first[i], first[i + 1])
        cost, audit, _ = cheapest([(roles[c], "t", b, 0) for c, b in zip(code[own], bad[own], strict=True)])
        assert (total[i], audits[i].decode()) == (cost, audit)
