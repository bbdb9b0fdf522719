"""Delivery of the event log as a stream."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import DEFAULT_PHASES, subscribed


def event_stream(spark: SparkSession, path: str, schema, files: str = "*.parquet") -> DataFrame:
    """Events appended to a folder as Parquet files of that name pattern, as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(path)


class Sinks:
    """Named sinks that may be attached and detached while a stream runs; a batch goes to
    those that are attached when it comes."""

    def __init__(self, sinks: dict[str, Callable[[DataFrame, int], None]] | None = None):
        self._sinks, self._lock = dict(sinks or {}), threading.Lock()

    def attach(self, name: str, sink: Callable[[DataFrame, int], None]) -> Callable[[], None]:
        """Attaches a sink; what is returned detaches it (again and again without effect)."""
        with self._lock:
            self._sinks[name] = sink
        return lambda: self.detach(name, sink)

    def detach(self, name: str, sink: Callable[[DataFrame, int], None] | None = None) -> None:
        with self._lock:
            if sink is None or self._sinks.get(name) is sink:
                self._sinks.pop(name, None)

    def now(self) -> dict[str, Callable[[DataFrame, int], None]]:
        with self._lock:
            return dict(self._sinks)


def deliver(stream: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]] | Sinks, checkpoint: str, phases=DEFAULT_PHASES, node_events: bool = False, dead_letters: str | None = None) -> StreamingQuery:
    """Hands each micro-batch to all sinks; a sink's failure is recorded, the others still run.

    Batches repeat after a crash under the same number, so a sink that writes by batch number
    writes once. A batch that a sink fails on is lost to that sink, as an observer's error
    mustn't stop the run; with dead_letters, a folder that all machines share, it is written
    there below sink and batch number. Drain with drain().
    """
    failures: list[tuple[int, str, str]] = []
    rows: dict[str, int] = {}
    sinks = sinks if isinstance(sinks, Sinks) else Sinks(sinks)

    def hand_over(batch: DataFrame, number: int) -> None:
        batch.persist()
        # counted before the phases are looked at: what no sink asks for is delivered, too
        count, chosen = batch.count(), subscribed(batch, phases) if node_events else batch
        for name, sink in sinks.now().items():
            try:
                sink(chosen, number)
            except Exception as e:  # noqa: BLE001  an observer's error is a warning, not the run's
                failures.append((number, name, repr(e)))
                if dead_letters is not None:
                    chosen.write.mode("overwrite").parquet(f"{dead_letters}/sink={name}/batch={number}")
        batch.unpersist()
        rows["all"] = rows.get("all", 0) + count

    q = stream.writeStream.foreachBatch(hand_over).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.sink_failures, q.handed_over = failures, rows
    return q


def drain(q: StreamingQuery, total: int, seconds: float | None = None) -> dict[str, int | bool]:
    """Waits until all is delivered or the time is over: undelivered events of `total`, timed_out.

    Delivered is what `deliver` has handed over since it was started, however many batches.
    """
    ended = q.awaitTermination(seconds) if seconds is not None else (q.awaitTermination(), True)[1]
    return {"undelivered": max(0, total - q.handed_over.get("all", 0)), "timed_out": not ended}


def windowed_counts(stream: DataFrame, at: str, late: str, width: str, *dims: str) -> DataFrame:
    """Counts in tumbling windows with a watermark: state older than `late` is dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *dims).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *dims, "n")
