"""Keyed state over the event stream: each invocation's events in order and once, and its spans.

Events carry a number in their invocation, 1 and up. What arrives early is held in the state
until those before it have come; what has been emitted before is dropped, also after a
restart, as the state is part of the stream's checkpoint. A gap that isn't filled within the
patience (by event time) is given up: what is held goes out in order, marked late. The state
of an invocation is a few numbers, what it holds and its open spans. Invocations are dealt by
hash to a fixed number of buckets, whose states are kept and advanced together as columns: a
call of Python takes a bucket's part of a micro-batch, not an invocation's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import BooleanType, IntegralType, LongType, StringType, StructField, StructType

#: Groups of keys that share a state; as part of the checkpoint it stays as it is over restarts.
BUCKETS = 1024
#: A time that never comes, and one before all others (of rows without time).
NEVER, BEFORE = 2**62, -(2**62)


def _packed(held: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(held, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_all().to_pandas()


def _ranks(groups: np.ndarray) -> np.ndarray:
    """Each entry's place in its group, from 0; groups stand together."""
    n = np.arange(len(groups))
    return n - np.maximum.accumulate(np.where(np.r_[True, groups[1:] != groups[:-1]], n, 0)) if len(groups) else n


class _Bucket:
    """A bucket's keys (next number, place, last event, when patience is over), and the rows that they hold.

    A key is due in a call that brings it nothing, once the watermark is past its time: as if
    it were a group of its own, whose time is up.
    """

    def __init__(self, key: str, state: GroupState):
        self.key, self.state, self.watermark = key, state, state.getCurrentWatermarkMs()
        packed = state.get if state.exists else (None, None, None)
        keys, self.held, self.extra = (None if x is None else _unpacked(x) for x in packed)
        self.names = None if keys is None else keys["name"]
        none = np.zeros(0, np.int64)
        self.next, self.place, self.last, self.wake = (none if keys is None else keys[c].to_numpy().copy() for c in ("next", "place", "last", "wake"))

    def slots(self, names: pd.Series) -> np.ndarray:
        """The place of each name among the keys; new ones are added."""
        every = names if self.names is None else pd.concat([self.names, names], ignore_index=True)
        codes, uniques = pd.factorize(every)
        more = len(uniques) - len(self.next)
        self.names = pd.Series(uniques, dtype=every.dtype)
        for name, first in (("next", 1), ("place", 0), ("last", BEFORE), ("wake", NEVER)):
            setattr(self, name, np.concatenate([getattr(self, name), np.full(more, first, np.int64)]))
        return codes[len(every) - len(names) :]

    def advance(self, batches: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame | None, np.ndarray, np.ndarray]:
        """(rows that come out, their keys' slots, their places): each key's run from its next number on, of due keys all."""
        frames = [] if self.state.hasTimedOut else list(batches)
        n_held = 0 if self.held is None else len(self.held)
        frames = [self.held, *frames] if n_held else frames
        if not frames:
            self.touched = np.zeros(len(self.next), bool)
            self.due, self.holds = self.wake < self.watermark, np.zeros(0, np.int64)
            return None, self.holds, self.holds
        every = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        slot, number = self.slots(every[self.key]), every["_number"].to_numpy()
        self.touched = np.zeros(len(self.next), bool)
        self.touched[slot[n_held:]] = True
        self.due = ~self.touched & (self.wake < self.watermark)
        order = np.flatnonzero(number >= self.next[slot])
        order = order[np.lexsort((number[order], slot[order]))]  # stable: of one number the first to arrive
        s, n = slot[order], number[order]
        once = np.r_[True, (s[1:] != s[:-1]) | (n[1:] != n[:-1])] if len(order) else np.zeros(0, bool)
        order, s, n = order[once], s[once], n[once]
        rank = _ranks(s)
        out = self.due[s] | (n == self.next[s] + rank)
        places = self.place[s[out]] + rank[out] + 1
        self.next[s[out]] = n[out] + 1  # rising by key: the last one stays
        self.place += np.bincount(s[out], minlength=len(self.place))
        self.held, self.holds = every.iloc[order[~out]], s[~out]
        return every.iloc[order[out]], s[out], places

    def keep(self, waits: np.ndarray, last: np.ndarray, extra: pd.DataFrame | None = None) -> None:
        """Updates the state; keys of this call that wait are due when the watermark, which is the patience behind, has passed `last`."""
        self.wake[self.touched | self.due] = NEVER
        own = self.touched & waits
        self.wake[own] = np.maximum(last[own] // 1000, self.watermark) + 1
        keys = pd.DataFrame({"name": self.names, "next": self.next, "place": self.place, "last": self.last, "wake": self.wake})
        some = lambda f: None if f is None or not len(f) else _packed(f)
        self.state.update((some(keys), some(self.held), some(extra)))
        soonest = int(self.wake.min()) if len(self.wake) else NEVER
        if soonest < NEVER:
            self.state.setTimeoutTimestamp(max(soonest, self.watermark, 1))


def _micros(at: Column) -> Column:
    return F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(BEFORE))


def _instant(micros: Column) -> Column:
    return F.when(micros != BEFORE, F.timestamp_micros(micros))


def _grouped(stream: DataFrame, key: str, sequence: str, at: str, patience: str, buckets: int, more: list[Column]):
    """The stream by buckets, as Python gets it: numbers and times as whole numbers."""
    rows = stream.where(F.col(key).isNotNull() & F.col(sequence).isNotNull()).withWatermark(at, patience)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket")
    return rows.select(bucket, key, F.col(sequence).cast("long").alias("_number"), _micros(F.col(at)).alias("_micros"), *more, F.col(at).alias("_mark")).groupBy("_bucket")


_STATE = "keys binary, held binary, spans binary"


def in_order(stream: DataFrame, key: str, sequence: str, at: str, patience: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """The stream's rows in the order of `sequence` by key, each number once, with two columns:

    place: how many rows of the key have been emitted up to this one; late: whether it came
    out by giving up a gap. Rows without key or number are dropped, as are those that come
    when the patience (by event time, over all keys) is over. Of rows with one number the
    first to arrive stays.
    """
    rest = [f for f in stream.schema.fields if f.name not in (key, sequence, at)]
    # whole numbers that may be null go as number and flag: pandas would make them floats
    whole = [f.name for f in rest if isinstance(f.dataType, IntegralType)]
    sent = [F.coalesce(f.name, F.lit(0).cast(f.dataType)).alias(f.name) if f.name in whole else F.col(f.name) for f in rest]
    long = lambda n: StructField(n, LongType())
    out = StructType([
        stream.schema[key], long("_number"), long("_micros"), *rest, *(StructField(f"_null_{n}", BooleanType()) for n in whole), long("place"), StructField("late", BooleanType())
    ])
    names = [f.name for f in out.fields[:-2]]

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = _Bucket(key, state)
        ready, slots, places = bucket.advance(f[names] for f in batches)
        last, waits = np.full(len(bucket.next), BEFORE), np.zeros(len(bucket.next), bool)
        if len(bucket.holds):
            np.maximum.at(last, bucket.holds, bucket.held["_micros"].to_numpy())
            waits[bucket.holds] = True
        bucket.keep(waits, last)
        if len(slots):
            yield ready.assign(place=places, late=bucket.due[slots])

    rows = _grouped(stream, key, sequence, at, patience, buckets, [*sent, *(F.col(n).isNull().alias(f"_null_{n}") for n in whole)])
    got = rows.applyInPandasWithState(step, out, _STATE, "append", "EventTimeTimeout")
    back = {sequence: F.col("_number"), at: _instant(F.col("_micros")), **{n: F.when(~F.col(f"_null_{n}"), F.col(n)) for n in whole}}
    return got.select(*(back.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema.fields), "place", "late")


#: A span that has ended, or is given up: slot of its key, path, parent, start, end, category.
Ended = tuple[int, str, str | None, int, int | None, str | None]


def _spans_of(events: Iterator[tuple], open_: dict[int, dict[str, tuple[int, str | None]]]) -> list[Ended]:
    """Applies events in order to the open spans (by slot, path: start and parent); the spans that end."""
    ended = []
    for slot, path, when, kind, category in events:
        if kind == "started":
            own = open_.setdefault(slot, {})
            if path not in own:
                parent, cut = None, path.rfind("/")
                while cut > 0 and (parent := path[:cut]) not in own:
                    parent, cut = None, path.rfind("/", 0, cut)
                own[path] = (when, parent)
        elif kind == "completed" and path in (own := open_.get(slot, {})):
            start, parent = own.pop(path)
            ended.append((slot, path, parent, start, when, category))
    return ended


def assembled_spans(stream: DataFrame, key: str, sequence: str, at: str, namespace: str = "namespace", phase: str = "phase", category: str | None = None, patience: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """A row for each span as it ends: key, namespace, parent, start, end, category, open.

    namespace: the node's path, `a/b/c`. A span's parent is the longest beginning of its path
    that is open when it starts. Events are put in order first, so a completed event may come
    before its started one. A second started event of an open span and a completed one of
    none have no effect. Spans that nothing ends within the patience after the invocation's
    last event are given out with open = true and without an end.
    """
    out = StructType([
        stream.schema[key], StructField("namespace", StringType()), StructField("parent", StringType()), StructField("start", LongType()), StructField("end", LongType()),
        StructField("category", StringType()), StructField("open", BooleanType()),
    ])
    names = [key, "_number", "_micros", "_path", "_phase", "_category"]

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = _Bucket(key, state)
        ready, slots, _places = bucket.advance(f[names] for f in batches)
        open_: dict[int, dict[str, tuple[int, str | None]]] = {}
        if bucket.extra is not None:
            for slot, path, start, parent in zip(*(bucket.extra[c].tolist() for c in ("slot", "path", "start", "parent"))):
                open_.setdefault(slot, {})[path] = (start, parent)
        rows: list[Ended] = []
        if len(slots):
            rows = _spans_of(zip(slots.tolist(), *(ready[c].tolist() for c in ("_path", "_micros", "_phase", "_category"))), open_)
            np.maximum.at(bucket.last, slots, ready["_micros"].to_numpy())
        if len(bucket.holds):
            np.maximum.at(bucket.last, bucket.holds, bucket.held["_micros"].to_numpy())
        n_ended = len(rows)
        for slot in np.flatnonzero(bucket.due).tolist():
            rows += [(slot, path, parent, start, None, None) for path, (start, parent) in open_.pop(slot, {}).items()]
        left = [(slot, path, start, parent) for slot, own in open_.items() for path, (start, parent) in own.items()]
        waits = np.zeros(len(bucket.next), bool)
        waits[bucket.holds] = True
        waits[[x[0] for x in left]] = True
        bucket.keep(waits, bucket.last, pd.DataFrame(left, columns=["slot", "path", "start", "parent"]))
        if rows:
            made = pd.DataFrame(rows, columns=["_slot", "namespace", "parent", "start", "end", "category"], dtype=object)
            made.insert(0, key, bucket.names.take(made["_slot"].astype(int)).to_numpy())
            yield made.drop(columns="_slot").assign(open=np.arange(len(rows)) >= n_ended)

    more = [F.col(namespace).alias("_path"), F.col(phase).alias("_phase"), (F.col(category) if category else F.lit(None)).cast("string").alias("_category")]
    rows = _grouped(stream, key, sequence, at, patience, buckets, more)
    got = rows.applyInPandasWithState(step, out, _STATE, "append", "EventTimeTimeout")
    return got.select(key, "namespace", "parent", _instant(F.col("start")).alias("start"), _instant(F.col("end")).alias("end"), "category", "open")
