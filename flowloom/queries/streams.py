"""The event log as a stream that arrives shuffled and twice: ordered delivery and spans, over a restart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import table
from ..sources.scratch import Scratch
from ..streaming.delivery import deliver
from ..streaming.ordered import assembled_spans, in_order
from .registry import query


def _events(spark, d, *more: str):
    """The events with instants for times without a zone, the same whatever the session's zone."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', CAST(ts AS TIMESTAMP_NTZ))")
    return table(spark, d, "events", "event_id", "user_id", "ts", *more).withColumn("ts", F.timestamp_micros(micros))


#: About how many rows a file of the stream has; its micro-batches are as many at any size.
ROWS_A_FILE = 1_000_000


def _arriving(spark, rows, name: str, of: str, made):
    """Feeds `rows` to a stream in shuffled files, half of them before a restart, some twice; what it gives out, by batch.

    Patience is longer than all of the events' time, so that none is late however they are dealt.
    A row of its own far in the future comes last, so that patience is over.
    """
    scratch = Scratch(spark, name)
    root = scratch.root
    # numbered and dealt once; the halves, and what comes twice, are read from there
    saved, n = scratch.counted(rows.withColumn("part", F.pmod(F.xxhash64(of), F.lit(4))), F.lit(True))
    times = max(1, n // ROWS_A_FILE)
    every = saved.unionByName(saved.where(F.col(of) % 10 == 0))
    first, latest = saved.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    days = ((latest or 0) - (first or 0)) // 86_400_000_000 + 2
    last = {"user_id": F.lit(-1), "seq": F.lit(1), "ts": F.col("ts") + F.expr(f"interval {days + 1} days")}
    end = saved.agg(F.max("ts").alias("ts")).select(*(last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema))
    for some in (*(every.where(F.col("part") % 2 == half).drop("part").repartition(3 * times, of) for half in (0, 1)), end):
        some.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2 * times).parquet(f"{root}/in")
        sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        q = deliver(made(stream, f"{days} days"), {"table": sink}, f"{root}/checkpoint")
        q.awaitTermination()
        if q.sink_failures:
            raise RuntimeError(str(q.sink_failures))
    return spark.read.parquet(f"{root}/out").where("user_id >= 0")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, true AS serial, false AS late FROM events")
def stream_ordered_delivery(spark, d):
    """Every event of a user once and in order, whatever the order of arrival; `serial`: no earlier batch than the one before it."""
    e = _events(spark, d)
    e = e.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    got = _arriving(spark, e, "ordered", "event_id", lambda s, patience: in_order(s, "user_id", "seq", "ts", patience))
    before = F.lag("batch").over(Window.partitionBy("user_id").orderBy("place"))
    return got.select("event_id", "user_id", "place", (F.coalesce(before, F.col("batch")) <= F.col("batch")).alias("serial"), "late")


@query("""WITH e AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
SELECT a.user_id, 's/' || a.event_type AS namespace, 's' AS parent, epoch_us(a.ts) AS start_us, epoch_us(b.ts) AS end_us, b.ts IS NULL AS open
FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.event_type = a.event_type AND b.k = a.k + 1 WHERE a.k % 2 = 1
UNION ALL SELECT user_id, 's', NULL, epoch_us(min(ts)), CASE WHEN user_id % 2 = 0 THEN epoch_us(max(ts)) END, user_id % 2 = 1 FROM events GROUP BY user_id""")
def stream_spans(spark, d):
    """A user's odd events of a type start a span and the even ones end it, below one for the user that only even users end."""
    e = _events(spark, d, "event_type")
    odd = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) % 2 == 1
    own = e.select("event_id", "user_id", "ts", F.concat(F.lit("s/"), "event_type").alias("namespace"), F.when(odd, "started").otherwise("completed").alias("phase"), F.lit(1).alias("rank"))
    root = e.groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    ends = F.explode(F.when(F.col("user_id") % 2 == 0, F.array(F.struct(F.col("first").alias("ts"), F.lit("started").alias("phase"), F.lit(0).alias("rank")), F.struct(F.col("last").alias("ts"), F.lit("completed").alias("phase"), F.lit(2).alias("rank"))))
                     .otherwise(F.array(F.struct(F.col("first").alias("ts"), F.lit("started").alias("phase"), F.lit(0).alias("rank")))))
    root = root.select("user_id", ends.alias("e")).select((-F.col("user_id") * 2 - F.col("e.rank")).cast("long").alias("event_id"), "user_id", "e.ts", F.lit("s").alias("namespace"), "e.phase", "e.rank")
    both = own.unionByName(root).withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", F.col("rank"), "event_id")).cast("long")).drop("rank")
    got = _arriving(spark, both, "spans", "event_id", lambda s, patience: assembled_spans(s, "user_id", "seq", "ts", patience=patience))
    return got.select("user_id", "namespace", "parent", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "open")
