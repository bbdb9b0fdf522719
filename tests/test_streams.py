"""Ordered delivery and span assembly by keyed state, over restarts."""

import datetime
import random

from flowloom.queries.streams import stream_ordered_delivery, stream_spans
from flowloom.streaming.delivery import deliver, drain, event_stream
from flowloom.streaming.ordered import BUCKETS, assembled_spans, in_order

KIND = "run string, seq long, at timestamp, note string"
START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def written(spark, src, rows, kind):
    """A Parquet file for each list of rows, in that order."""
    for part in rows:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(src)


def collected(spark, stream, cp):
    """Runs the stream to its end; its rows by batch."""
    got = []
    q = deliver(stream, {"list": lambda b, n: got.extend((n, *r) for r in sorted(b.collect(), key=lambda r: (str(r[0]), r["place"] if "place" in r else 0)))}, cp)
    q.awaitTermination()
    return got


def test_shuffled_and_repeated_events_come_out_once_in_order_after_a_restart(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"r{k}", s, at(10 * s + k), None if s % 3 else f"n{s}") for k in range(5) for s in range(1, 21)]
    rows += r.sample(rows, 40)
    r.shuffle(rows)
    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")
    cuts = [rows[i : i + 28] for i in range(0, len(rows), 28)]
    stream = lambda: in_order(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(src), "run", "seq", "at", "1 day")
    written(spark, src, cuts[:3], KIND)
    first = collected(spark, stream(), cp)
    written(spark, src, cuts[3:], KIND)
    second = collected(spark, stream(), cp)
    for k in range(5):
        mine = [x for x in first + second if x[1] == f"r{k}"]
        assert [x[2] for x in mine] == list(range(1, 21)) == [x[5] for x in mine] and not any(x[6] for x in mine)
        assert [x[4] for x in mine] == [None if s % 3 else f"n{s}" for s in range(1, 21)]
        assert [x[0] for x in mine if x in second] == sorted(x[0] for x in mine if x in second)
    # all of it again: nothing comes out
    written(spark, src, [rows], KIND)
    assert collected(spark, stream(), cp) == []


def test_gaps_are_given_up_by_event_time(spark, tmp_path):
    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")
    stream = lambda: in_order(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(src), "run", "seq", "at", "1 minute")
    written(spark, src, [[("a", 1, at(0), "x"), ("a", 3, at(2), "x"), (None, 1, at(0), "x"), ("b", None, at(0), "x")]], KIND)
    assert [x[1:3] + x[6:] for x in collected(spark, stream(), cp)] == [("a", 1, False)]
    written(spark, src, [[("clock", 1, at(3600), "x")]], KIND)
    assert sorted(x[1:3] + x[5:] for x in collected(spark, stream(), cp)) == [("a", 3, 2, True), ("clock", 1, 1, False)]
    written(spark, src, [[("a", 2, at(1), "x"), ("a", 4, at(4000), "x")]], KIND)
    assert [x[1:3] + x[5:] for x in collected(spark, stream(), cp)] == [("a", 4, 3, False)]  # 2 is too late


def test_drain_counts_every_batch_and_filtered_events(spark, tmp_path):
    src = str(tmp_path / "src")
    written(spark, src, [[(k, "node", "started" if k % 2 else "completed")] for k in range(12)], "id int, kind string, phase string")
    seen = []
    source = spark.readStream.schema("id int, kind string, phase string").option("maxFilesPerTrigger", 1).parquet(src)
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    try:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
        q = deliver(source, {"s": lambda b, n: seen.extend(r["id"] for r in b.collect())}, str(tmp_path / "cp"), phases=("started",), node_events=True)
        assert drain(q, 15) == {"undelivered": 3, "timed_out": False}
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    assert sorted(seen) == [1, 3, 5, 7, 9, 11]
    assert event_stream(spark, src, "id int").isStreaming


def test_spans_are_assembled_with_parents_and_time_outs(spark, tmp_path):
    kind = "run string, seq long, at timestamp, namespace string, phase string, category string"
    tree = [("a", "started"), ("a/b", "started"), ("a/b", "completed"), ("a/c/d", "started"), ("a/c/d", "completed"), ("a", "completed"), ("e", "started"), ("e", "started"), ("x", "completed"), ("e/f", "started")]
    rows = [(run, k + 1, at(k), path, phase, "bad" if path == "a/b" else None) for run in ("r1", "r2") for k, (path, phase) in enumerate(tree)]
    random.Random(1).shuffle(rows)
    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")
    stream = lambda: assembled_spans(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src), "run", "seq", "at", category="category", patience="1 minute")
    written(spark, src, [rows[:9], rows[9:]], kind)
    first = collected(spark, stream(), cp)
    for run in ("r1", "r2"):
        mine = {x[2]: x[3:] for x in first if x[1] == run}
        assert mine == {"a/b": ("a", at(1), at(2), "bad", False), "a/c/d": ("a", at(3), at(4), None, False), "a": (None, at(0), at(5), None, False)}
    written(spark, src, [[("clock", 1, at(3600), "t", "completed", None)]], kind)
    assert sorted((x[1], x[2], x[3], x[5], x[7]) for x in collected(spark, stream(), cp)) == [(r, *s) for r in ("r1", "r2") for s in (("e", None, None, True), ("e/f", "e", None, True))]


def test_many_keys_share_states_and_whole_numbers_stay_whole(spark, tmp_path):
    kind = "run string, seq long, at timestamp, big long"
    rows = [(f"r{k}", s, at(s), 2**53 + 2 * k + 1 if (k + s) % 2 else None) for k in range(1500) for s in (1, 2)]
    random.Random(2).shuffle(rows)
    src, got = str(tmp_path / "src"), []
    written(spark, src, [rows[:1500], rows[1500:]], kind)
    stream = in_order(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src), "run", "seq", "at", "1 day")
    q = deliver(stream, {"list": lambda b, n: got.extend(tuple(r) for r in b.collect())}, str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(got) == sorted((*r, r[1], False) for r in rows)
    # calls of Python a batch: one for a bucket, however many keys there are
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= BUCKETS < 1500


def test_patience_is_over_by_key_within_a_bucket(spark, tmp_path):
    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")
    stream = lambda: in_order(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(src), "run", "seq", "at", "1 minute", buckets=1)
    written(spark, src, [[("a", 1, at(0), "x"), ("a", 3, at(2), "x"), ("b", 1, at(0), "x")], [("clock", 1, at(3600), "x")], [("b", 3, at(3650), "x"), ("b", 2, at(3640), "x"), ("c", 2, at(3650), "x")]], KIND)
    first = [x[1:3] + x[5:] for x in collected(spark, stream(), cp)]
    # a's time is over while b and c get events; c waits on
    assert sorted(first) == [("a", 1, 1, False), ("a", 3, 2, True), ("b", 1, 1, False), ("b", 2, 2, False), ("b", 3, 3, False), ("clock", 1, 1, False)]
    written(spark, src, [[("c", 1, at(3660), "x"), ("a", 2, at(3670), "x")]], KIND)
    assert [x[1:3] + x[5:] for x in collected(spark, stream(), cp)] == [("c", 1, 1, False), ("c", 2, 2, False)]


def test_spans_of_many_runs_share_states(spark, tmp_path):
    kind = "run long, seq long, at timestamp, namespace string, phase string"
    tree = [("a", "started"), ("a/b/c", "started"), ("a/b/c", "completed"), ("b", "started")]
    rows = [(run, k + 1, at(k), *e) for run in range(1500) for k, e in enumerate(tree)]
    random.Random(4).shuffle(rows)
    src, got = str(tmp_path / "src"), []
    written(spark, src, [rows[:3000], rows[3000:], [(-1, 1, at(3600), "t", "completed")]], kind)
    stream = assembled_spans(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src), "run", "seq", "at", patience="1 minute")
    q = deliver(stream, {"list": lambda b, n: got.extend(tuple(r) for r in b.collect())}, str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(got, key=str) == sorted((s for r in range(1500) for s in ((r, "a", None, at(0), None, None, True), (r, "a/b/c", "a", at(1), at(2), None, False), (r, "b", None, at(3), None, None, True))), key=str)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= BUCKETS


def test_events_of_many_years_are_all_delivered(spark, tmp_path):
    kind = "event_id long, ts timestamp, user_id long, event_type string"
    rows = [(k, at(86_400 * 60 * k), k % 3, "view") for k in range(120)]  # 20 years
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in stream_ordered_delivery(spark, str(tmp_path)).collect())
    assert got == [(k, k % 3, k // 3 + 1, True, False) for k in range(120)]
    spans = [(r["user_id"], r["namespace"], r["open"]) for r in stream_spans(spark, str(tmp_path)).collect()]
    assert sorted(spans) == sorted([(u, "s", u == 1) for u in range(3)] + [(u, "s/view", False) for u in range(3) for _ in range(20)])
