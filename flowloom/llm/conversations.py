"""Conversation structure repair: the cheapest edits that make roles alternate.

A conversation is well formed if the initials of its roles read `(s?(ua)+)?`. Keeping a turn
costs 0, giving it the role user or assistant 2, deleting it 3, inserting an empty turn 2; a
blank turn or one that repeats an earlier turn must go, one that ends without `.`, `!` or
`?` costs 1 more if it stays. Of equally cheap edits the ASCII-least string of initials
(Delete, Insert, Keep, Rerole) counts.

The search is a dynamic program over four states (nothing yet, after s, after u, after a).
Turns are reduced to a code of one byte and a hash first; conversations are put into buckets
of similar length, and one numpy step a turn updates the costs of all conversations of a
bucket at once, from the last turn to the first (time-major: turn x conversation x state).
The kept costs then give every conversation's next edit in one step, until all have ended.

The texts come in only after that: each conversation's edits are dealt to its turns, which
stream through in order, so that no conversation's texts are held together. What a task
holds of a conversation is about 60 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Turns that one vectorised step gathers; a longer conversation is a step of its own.
TURNS = 1 << 16

#: States: nothing yet, after s, after u, after a; NONE can't be reached.
START, SYSTEM, USER, ASSISTANT, NONE = range(5)
#: The state after a turn that an edit makes (always the one role that may follow).
MADE = np.array([USER, USER, ASSISTANT, USER])
#: The state after a kept turn, by its role's initial (s, u, a, other) and the state before.
KEPT = np.array([[SYSTEM, NONE, NONE, NONE], [USER, USER, NONE, USER], [NONE, NONE, ASSISTANT, NONE], [NONE] * 4])
ROLES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 29
#: Bits of a turn's code above its initial.
BLANK, TRUNCATED, ABSENT = 4, 8, 16


# ------------------------------------------------------------------ edits


def bucketed(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of conversations whose lengths have the same power of two above them."""
    size = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for k in np.unique(size):
        yield np.flatnonzero(size == k)


def backward(code: np.ndarray, bad: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Costs (turns + 1, conversations, 5 states) of what is still to do from each turn on.

    code, bad: turns x conversations, what lies behind a conversation's length counts for
    nothing; bad turns must be deleted.
    """
    turns, n = code.shape
    cost = np.full((turns + 1, n, 5), FAR, np.int32)
    cost[turns, :, :4] = [0, 2 * INSERT, INSERT, 0]
    for t in range(turns - 1, -1, -1):
        after = cost[t + 1]
        cut = CUT * ((code[t] & TRUNCATED) > 0)[:, None].astype(np.int32)
        stay = np.minimum(np.take_along_axis(after, KEPT[code[t] & 3], 1) + KEEP, after[:, MADE] + REROLE) + cut
        now = np.minimum(after[:, :4] + DELETE, np.where(bad[t][:, None], FAR, stay))
        for _ in range(2):
            now = np.minimum(now, now[:, MADE] + INSERT)
        cost[t, :, :4] = np.where((t < length)[:, None], now, after[:, :4])
    return cost


def traced(code: np.ndarray, bad: np.ndarray, length: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The edits' initials (edits x conversations, 0: none) along the kept costs."""
    n = code.shape[1]
    at, state = np.zeros(n, np.int64), np.full(n, START)
    open_, out = np.arange(n), []
    while True:
        open_ = open_[(at[open_] < length[open_]) | ~np.isin(state[open_], (START, ASSISTANT))]
        if not len(open_):
            break
        p, s = at[open_], state[open_]
        inside = p < length[open_]
        row = np.where(inside, p, 0)
        c = code[row, open_]
        now = cost[p, open_, s]
        delete = inside & (now == cost[np.minimum(p + 1, len(cost) - 1), open_, s] + DELETE)
        insert = ~delete & (now == cost[p, open_, MADE[s]] + INSERT)
        kept = KEPT[c & 3, s]
        stays = inside & ~bad[row, open_]
        keep = ~delete & ~insert & stays & (now == cost[np.minimum(p + 1, len(cost) - 1), open_, kept] + KEEP + CUT * ((c & TRUNCATED) > 0))
        state[open_] = np.where(delete, s, np.where(keep, kept, MADE[s]))
        at[open_] = p + ~insert
        step = np.zeros(n, np.uint8)
        step[open_] = np.select([delete, insert, keep], [ord("D"), ord("I"), ord("K")], ord("R"))
        out.append(step)
    return np.array(out, np.uint8).reshape(len(out), n)


def edits(code: np.ndarray, bad: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Cost and audit of each conversation; conversation i has the turns first[i]:first[i + 1]."""
    length = np.diff(first)
    total, audits = np.zeros(len(length), np.int64), [b""] * len(length)
    for who in bucketed(length):
        turns = int(length[who].max())
        if not turns:
            continue
        t = np.arange(turns)[:, None]
        there = t < length[who]
        place = np.where(there, first[who] + t, 0)
        c, b = np.where(there, code[place], 0), np.where(there, bad[place], False)
        cost = backward(c, b, length[who])
        letters = traced(c, b, length[who], cost).T
        total[who] = cost[0, :, START]
        data, ends = letters[letters > 0].tobytes(), np.cumsum((letters > 0).sum(1))
        for k, i in enumerate(who):
            audits[i] = data[ends[k - 1] if k else 0 : ends[k]]
    return total, audits


# ------------------------------------------------------------------ first pass: codes


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each entry differs from the one before (nulls are equal); the first does."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.r_[True, ~np.asarray(same.to_numpy(zero_copy_only=False), bool)]


def _audited(table: pa.Table) -> pa.RecordBatch:
    """Whole conversations in order: id, turn, code, two hashes of role and text."""
    ids = table.column(0).combine_chunks()
    starts = np.flatnonzero(_changes(ids))
    who = np.cumsum(np.bincount(starts, minlength=len(ids))) - 1
    code = table.column(2).to_numpy().astype(np.uint8)
    there = np.flatnonzero((code & ABSENT) == 0)
    turn, n, whose, code = table.column(1).combine_chunks().take(pa.array(there)), len(starts), who[there], code[there]
    h1, h2 = (table.column(k).to_numpy()[there] for k in (3, 4))
    # a row is a copy unless it is the first of its conversation's rows with its hashes
    order = np.lexsort((np.arange(len(code)), h2, h1, whose))
    again = np.zeros(len(code), bool)
    a, b = order[1:], order[:-1]
    again[a] = (whose[a] == whose[b]) & (h1[a] == h1[b]) & (h2[a] == h2[b])
    blank = (code & BLANK) > 0
    again &= ~blank
    count = lambda x: np.bincount(whose[x], minlength=n)
    initial, known = code & 3, np.flatnonzero(~np.asarray(turn.is_null()))
    pair = np.zeros(len(code), bool)  # a row and the one before it in its conversation
    pair[1:] = whose[1:] == whose[:-1]
    fine = np.zeros((4, 4), bool)
    fine[0, 1] = fine[1, 2] = fine[2, 1] = True
    illegal = np.flatnonzero(pair)
    illegal = illegal[~fine[initial[illegal - 1], initial[illegal]]]
    number, own = turn.take(pa.array(known)).to_numpy().astype(np.int64), whose[known]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (number[1:] != number[:-1])
    gaps = np.zeros(n, np.int64)
    if len(own):
        opens = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        closes = np.r_[opens[1:], len(own)] - 1
        gaps[own[opens]] = number[closes] - number[opens] + 1 - np.add.reduceat(new.astype(np.int64), opens)
    cost, audit = edits(code, blank | again, np.searchsorted(whose, np.arange(n + 1)))
    cut = ((code & TRUNCATED) > 0) & ~blank & ~again
    columns = [ids.take(pa.array(starts)), *(pa.array(x.astype(np.int64)) for x in (gaps, count(blank), count(again), count(cut), count(illegal), cost)), pa.array([a.decode() for a in audit], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def _audit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over turns in order. Conversations are gathered whole, TURNS or more at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= TURNS:
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_changes(table.column(0).combine_chunks()))[-1])
            if last:
                yield _audited(table.slice(0, last))
            held = table.slice(last).combine_chunks().to_batches()
            size = table.num_rows - last
    if size:
        yield _audited(pa.Table.from_batches(held))


# ------------------------------------------------------------------ second pass: texts


class _Repair:
    """One conversation's edits, dealt to its turns as they come by."""

    def __init__(self, audit: str):
        self.audit, self.next, self.state = audit, 0, START

    def _inserted(self):
        while self.next < len(self.audit) and self.audit[self.next] == "I":
            self.next += 1
            self.state = int(MADE[self.state])
            yield "I", ROLES[self.state], ""

    def turn(self, role: str, text: str):
        """(edit, role, text) of the inserted turns before this one, and of itself if it stays."""
        yield from self._inserted()
        edit = self.audit[self.next]
        self.next += 1
        if edit == "K":
            self.state = int(KEPT["sua".index(role[0]), self.state])
            yield edit, role, text
        elif edit == "R":
            self.state = int(MADE[self.state])
            yield edit, ROLES[self.state], text

    def end(self):
        yield from self._inserted()


def _stream(batches: Iterator[pa.RecordBatch]):
    """For each batch: the repaired turns, and the conversations that end, as they come.

    A conversation's first row has its edits, the others are its turns in order.
    """
    repair, head = None, None
    for batch in batches:
        for first, row, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if first:
                if repair is not None:
                    yield from ((head, line) for line in repair.end())
                    yield head, None
                repair, head = _Repair(text), row
            else:
                yield from ((head, line) for line in repair.turn(role, text))
    if repair is not None:
        yield from ((head, line) for line in repair.end())
        yield head, None


#: Rows of results that a batch holds.
ROWS = 1000


def _digest_task(kind: pa.DataType):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, empty, out = hashlib.sha256(), True, []
        for head, line in _stream(batches):
            if line is not None:
                digest.update(f"{'' if empty else chr(10)}{line[1]}:{line[2]}".encode())
                empty = False
                continue
            out.append((head, digest.hexdigest()))
            digest, empty = hashlib.sha256(), True
            if len(out) == ROWS:
                yield _digests(out, kind)
                out = []
        if out:
            yield _digests(out, kind)

    return task


def _digests(rows, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], kind), pa.array([d for _, d in rows], pa.string())], names=["row", "repaired_sha256"])


def _turns_task(kind: pa.DataType):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = [], 0
        for head, line in _stream(batches):
            if line is None:
                place = 0
                continue
            out.append((head, place, *line))
            place += 1
            if len(out) == ROWS:
                yield _lines(out, kind)
                out = []
        if out:
            yield _lines(out, kind)

    return task


def _lines(rows, kind) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (2, 3, 4))]
    return pa.RecordBatch.from_arrays(columns, names=["row", "place", "edit", "role", "text"])


# ------------------------------------------------------------------ tables


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """The turns with their codes and hashes; a null role or text is one blank."""
    said, who = F.coalesce(F.col(text).cast("string"), F.lit(" ")), F.coalesce(F.col(role).cast("string"), F.lit(" "))
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    made = rows.select(F.col(conv).alias("id"), F.col(turn).cast("long").alias("turn"), who.alias("role"), said.alias("text"), there.alias("there"))
    body = F.rtrim("text", F.lit(BLANK_CHARS))
    bit = lambda when, value: F.when(when, value).otherwise(0)
    initial = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1).when(F.startswith("role", F.lit("a")), 2).otherwise(3)
    ends = F.substring(body, -1, 1).isin(".", "!", "?")
    code = initial + bit(body == "", BLANK) + bit((body != "") & ~ends, TRUNCATED) + bit(~F.col("there"), ABSENT)
    return made.select("id", "turn", "role", "text", "there", code.cast("int").alias("code"), F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(11), "role").alias("h2"))


#: Rows of one turn go by role, then by the hash of what they say, in both passes alike.
_ORDER = ("id", "turn", "role", "h1", "h2")


def _dealt(turns: DataFrame) -> DataFrame:
    """A row (id, counts and audit) for each conversation, and its rows (first, row, role, text) for the second pass."""
    kind = turns.schema["id"].dataType.simpleString()
    coded = turns.select("id", "turn", "code", "h1", "h2", "role").repartition("id").sortWithinPartitions(*_ORDER).drop("role")
    audits = coded.mapInArrow(_audit_task, f"id {kind}, {_COUNTS}")
    head = F.struct("id", *(c.split()[0] for c in _COUNTS.split(", ")))
    null = lambda t: F.lit(None).cast(t)
    first = audits.select("id", F.lit(True).alias("first"), null("long").alias("turn"), null("string").alias("role"), F.col("audit").alias("text"), null("long").alias("h1"), null("long").alias("h2"), head.alias("row"))
    rest = turns.where("there").select("id", F.lit(False).alias("first"), "turn", "role", "text", "h1", "h2", null(first.schema["row"].dataType).alias("row"))
    both = first.unionByName(rest).repartition("id").sortWithinPartitions("id", F.desc("first"), *_ORDER[1:])
    return both.select("first", "row", "role", "text")


def _run(task, dealt: DataFrame, made: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    row = dealt.schema["row"].dataType
    return dealt.mapInArrow(task(to_arrow_type(row)), f"row {row.simpleString()}, {made}")


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """A row for each value of `conv`: id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256.

    gaps: numbers that are missing between the smallest and the largest turn; blank,
    duplicate, truncated: turns by their first fault; illegal: neighbours whose roles don't
    alternate (only su, ua and au do); cost and audit: the cheapest edits; repaired_sha256:
    of the repaired `role:text` lines.

    Turns go by number, those without one first, and those of one number by role, then by a
    hash of the text. Null roles and texts are one blank; a role without an initial can't be kept; a null `conv` is a conversation.
    Rows where `present` doesn't hold aren't turns, but their conversation is reported: one
    without turns has zeros and empty edits. Repeated rows are duplicates. An empty table
    gives no rows; other columns aren't read. Texts stream through, however long; a
    conversation of any length is searched whole.
    """
    out = _run(_digest_task, _dealt(_turns(rows, conv, turn, role, text, present)), "repaired_sha256 string")
    return out.select("row.*", "repaired_sha256")


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """The repaired conversations themselves: id, place (from 0), edit (K, R or I), role, text.

    Rows and nulls as in `repaired`; a conversation that loses all turns has no row.
    """
    out = _run(_turns_task, _dealt(_turns(rows, conv, turn, role, text, present)), "place long, edit string, role string, text string")
    return out.select("row.id", "place", "edit", "role", "text")


# ------------------------------------------------------------------ the query


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """conversations with every 20th turn each dropped (marked), emptied, cut, repeated and given to the user; and which rows are left."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = (F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn"))) % 20).cast("int")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    times = F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = rows.select("conv_id", "turn", "role", "text", d.alias("_d")).select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(some("role")).alias("role"), text.alias("text"), "_d", times.alias("_copy"))
    return out, F.col("_d") != 0


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows, left = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repaired(rows, present=left).withColumnRenamed("id", "conv_id")


def _sql() -> str:
    """The same in DuckDB: a forward search; a state is its cost (9 digits), edits, \\x01 and lines."""

    def add(v: str, cost: str, letter: str, line: str) -> str:
        audit, said = f"split_part(substr({v}, 10), chr(1), 1)", f"substr({v}, 10 + strpos(substr({v}, 10), chr(1)))"
        joined = said if letter == "D" else f"CASE WHEN {said} = '' THEN {line} ELSE {said} || chr(10) || {line} END"
        return f"(lpad(CAST(CAST(substr({v}, 1, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || {audit} || '{letter}' || chr(1) || {joined})"

    def inserted(source: str, name: str) -> str:
        user = f"least(v2, {add('v0', '2', 'I', chr(39) + 'user:' + chr(39))}, {add('v1', '2', 'I', chr(39) + 'user:' + chr(39))}, {add('v3', '2', 'I', chr(39) + 'user:' + chr(39))})"
        one = f"(SELECT * REPLACE ({user} AS v2) FROM {source})"
        last = add("v2", "2", "I", "'assistant:'")
        two = f"(SELECT * REPLACE (least(v3, {last}) AS v3) FROM {one})"
        return f"(SELECT * REPLACE (least(v2, {add('v3', '2', 'I', chr(39) + 'user:' + chr(39))}) AS v2) FROM {two}) AS {name}"

    def stepped(state: int) -> str:
        ways = [add(f"v{state}", "3", "D", "''")]
        keeps = {1: [(0, "s")], 2: [(0, "u"), (1, "u"), (3, "u")], 3: [(2, "a")]}.get(state, [])
        ways += [f"CASE WHEN NOT bad AND init = '{c}' THEN {add(f'v{s}', 'cut', 'K', 'line')} END" for s, c in keeps]
        name = {2: "user", 3: "assistant"}.get(state)
        ways += [f"CASE WHEN NOT bad THEN {add(f'v{s}', '2 + cut', 'R', f'{chr(39)}{name}:{chr(39)} || text')} END" for s in ({2: (0, 1, 3), 3: (2,)}.get(state, ()))]
        return f"least({', '.join(ways)}) AS v{state}"

    table = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
    nibbles = "flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: [ascii(c) & 15, ascii(c) >> 4]))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {nibbles}::BIGINT[]), lambda a, b: xor(({table}::BIGINT[])[((xor(a, b)) & 15) + 1], a >> 4)))"
    return rf"""
WITH RECURSIVE hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS d FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE d <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
marked AS (SELECT *, substr(role, 1, 1) AS init, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cutoff FROM placed),
r AS (SELECT *, blank OR again AS bad, CAST(NOT blank AND NOT again AND cutoff AS INT) AS cut, role || ':' || text AS line FROM marked),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate, sum(cut) AS truncated,
    count_if(i > 1 AND prev || init NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, i, v0, v1, v2, v3 FROM {inserted("(SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' || chr(1) AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS VARCHAR) AS v3 FROM ids)", "a")}
  UNION ALL
  SELECT conv_id, i, v0, v1, v2, v3 FROM {inserted(f"(SELECT w.conv_id, r.i, {', '.join(stepped(s) for s in range(4))} FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)", "b")}),
best AS (SELECT w.conv_id, least(v0, v3) AS v FROM walk w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(c.n, 0))
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(substr(v, 1, 9) AS BIGINT) AS cost,
  split_part(substr(v, 10), chr(1), 1) AS audit, sha256(substr(v, 10 + strpos(substr(v, 10), chr(1)))) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""


OP11_SQL = _sql()
