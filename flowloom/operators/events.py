"""The event log and what is derived from it: filters, spans, metrics, drains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.telemetry import bucket

#: Phases of node events, and those that an observer sees by default.
PHASES = ("started", "completed", "checkpoint_saved", "checkpoint_migrated")
DEFAULT_PHASES = ("started", "completed")


def subscribed(events: DataFrame, phases: Sequence[str] = DEFAULT_PHASES, kind: str = "kind", phase: str = "phase") -> DataFrame:
    """Events that an observer of these phases gets; events that aren't of nodes always pass."""
    bad = [p for p in phases if p not in PHASES]
    if bad or not phases:
        raise ValueError(f"phases must be some of {PHASES}")
    return events.where((F.col(kind) != "node") | F.col(phase).isin(*phases))


def path_events(runs: DataFrame, key: str, path: str = "_path", error: str = "_error") -> DataFrame:
    """Started and completed events of runs that were traced: one pair per step."""
    steps = runs.select(key, F.posexplode(path).alias("step", "node"), F.size(path).alias("_n"), F.col(error)["category"].alias("_category"))
    failed = F.when(F.col("step") == F.col("_n") - 1, F.col("_category"))
    return steps.select(key, "step", "node", F.explode(F.array(F.lit("started"), F.lit("completed"))).alias("phase"), failed.alias("error_category")).withColumn(
        "error_category", F.when(F.col("phase") == "completed", F.col("error_category"))
    )


def spans(events: DataFrame, *key: str, at: str = "ts", phase: str = "phase") -> DataFrame:
    """A span for each key: start, end and whether it is still open; one aggregation."""
    start, end = F.min(F.when(F.col(phase) == "started", F.col(at))), F.max(F.when(F.col(phase) == "completed", F.col(at)))
    return events.groupBy(*key).agg(start.alias("start"), end.alias("end")).withColumn("open", F.col("end").isNull())


def with_parents(spans_: DataFrame, invocation: str = "invocation_id", namespace: str = "namespace") -> DataFrame:
    """Each span's parent: the longest namespace of its invocation that begins its own.

    Proper prefixes are made by slicing, so the search is an equi-join on (invocation, prefix)
    and not a comparison of all pairs.
    """
    every = spans_.select(invocation, F.col(namespace).alias("_own")).distinct()
    prefixes = every.where(F.size("_own") > 1).select(
        invocation, "_own", F.explode(F.transform(F.sequence(F.lit(1), F.size("_own") - 1), lambda k: F.slice("_own", F.lit(1), k))).alias("_prefix")
    )
    known = every.select(invocation, F.col("_own").alias("_prefix"))
    best = prefixes.join(known, [invocation, "_prefix"]).groupBy(invocation, "_own").agg(F.max_by("_prefix", F.size("_prefix")).alias("parent"))
    return spans_.join(best.withColumnRenamed("_own", namespace), [invocation, namespace], "left")


def detached(spans_: DataFrame, roots: Sequence[str] | DataFrame, invocation: str = "invocation_id", namespace: str = "namespace") -> DataFrame:
    """A trace for each span: below a detached node its own trace, else the invocation's.

    Detached nodes are few names, or a table with any number of them in its first column.
    """
    if isinstance(roots, DataFrame):
        names = roots.select(F.col(roots.columns[0]).alias("_name")).distinct()
        each = spans_.select(invocation, namespace).distinct().select(F.col(invocation).alias("_i"), F.col(namespace).alias("_n"), F.posexplode(namespace).alias("_at", "_name"))
        deepest = each.join(names, "_name").groupBy("_i", "_n").agg((F.max("_at") + 1).alias("_depth"))
        own = F.concat_ws("/", F.col(invocation), F.slice(namespace, F.lit(1), F.col("_depth")))
        out = spans_.join(deepest, F.col(invocation).eqNullSafe(F.col("_i")) & F.col(namespace).eqNullSafe(F.col("_n")), "left")
        return out.withColumn("trace", F.when(F.col("_depth").isNotNull(), own).otherwise(F.col(invocation))).drop("_i", "_n", "_depth")
    cut = F.filter(F.transform(F.col(namespace), lambda x, i: F.struct(x.alias("name"), (i + 1).alias("depth"))), lambda x: x["name"].isin(*roots))
    deepest = F.array_max(F.transform(cut, lambda x: x["depth"]))
    own = F.concat_ws("/", F.col(invocation), F.slice(namespace, F.lit(1), deepest))
    return spans_.withColumn("trace", F.when(F.size(cut) > 0, own).otherwise(F.col(invocation)))


def dispatch_spans(events: DataFrame, *key: str, at: str = "ts") -> DataFrame:
    """Grouping spans of fan-out instances or branches: first and last time of each key."""
    return events.groupBy(*key).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n_events"))


def histogram(samples: DataFrame, value: Column, bounds: Sequence[float], *dims: str) -> DataFrame:
    """Counts and sums by dimensions and bucket; missing values are left out."""
    s = samples.where(value.isNotNull()).select(*dims, bucket(value, bounds).alias("bucket"), value.alias("_v"))
    return s.groupBy(*dims, "bucket").agg(F.count("*").alias("n"), F.sum("_v").alias("total"))


def failure_counts(events: DataFrame, failed: Column, *dims: str) -> DataFrame:
    return events.where(failed).groupBy(*dims).agg(F.count("*").alias("n_failures"))


def timings(events: DataFrame, key: str, at: str = "ts", *order: str) -> DataFrame:
    """The time to the next event of the same key."""
    w = Window.partitionBy(key).orderBy(at, *order)
    return events.withColumn("next_at", F.lead(at).over(w))


def delivered(events: DataFrame, sequence: str, snapshot: int) -> DataFrame:
    """What a drain has to wait for: delivered and outstanding events up to a snapshot."""
    e = events.where(F.col(sequence) <= snapshot)
    return e.agg(F.count("*").alias("n_total"), F.count(F.when(F.col("delivered"), 1)).alias("n_delivered")).withColumn("n_outstanding", F.col("n_total") - F.col("n_delivered"))


def augmented(spans_: DataFrame, additions: DataFrame, invocation: str = "invocation_id", namespace: str = "namespace") -> DataFrame:
    """Metadata added at a namespace, on the spans of its ancestor path (itself included).

    additions: invocation, namespace, key, value, seq. Siblings and other invocations get
    nothing; the last addition of a key wins.
    """
    path = additions.select(
        invocation, F.explode(F.transform(F.sequence(F.lit(1), F.size(namespace)), lambda k: F.slice(namespace, F.lit(1), k))).alias(namespace), "key", "value", "seq"
    )
    last = path.groupBy(invocation, namespace, "key").agg(F.max_by("value", "seq").alias("value"))
    maps = last.groupBy(invocation, namespace).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))
    return spans_.join(maps, [invocation, namespace], "left")


def markers(events: DataFrame, at: str = "ts", kind: str = "kind", latency_ms: str = "latency_ms") -> DataFrame:
    """Spans of single events: degraded results and checkpoints have no length, a tool call
    began its latency before it was reported."""
    long = F.coalesce(F.when(F.col(kind) == "tool", F.col(latency_ms)), F.lit(0))
    return events.where(F.col(kind).isin("failure_isolated", "checkpoint", "tool")).withColumns({"start": F.col(at) - F.make_dt_interval(secs=long / 1000), "end": F.col(at)})


def children(observations: DataFrame, parent: str = "parent", name: str = "id") -> DataFrame:
    """How many children each observation of a trace has; leaves have 0."""
    n = observations.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(name)).agg(F.count("*").alias("n_children"))
    return observations.join(n, name, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def usage(events: DataFrame, *dims: str, counts: Sequence[str] = ("prompt_tokens", "completion_tokens")) -> DataFrame:
    """Accumulated usage by dimensions; what isn't reported doesn't count as 0."""
    return events.groupBy(*dims).agg(F.count("*").alias("n_calls"), *(F.sum(c).alias(c) for c in counts), *(F.count(c).alias(f"n_{c}") for c in counts))
