"""Events of all kinds as one table, made from runs and calls.

Columns: kind, invocation_id, correlation_id, node, at, category (null: it went well) and
attributes (canonical JSON of what the kind carries).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.telemetry import canonical_json
from .events import path_events

#: Kinds of events; a failed call has a kind of its own.
CALLS = {
    "llm": ("llm_completion", "llm_failed"), "embedding": ("embedding", "embedding_failed"), "rerank": ("rerank", "rerank_failed"), "tool": ("tool_call", "tool_call_failed"),
}


def _event(kind: Column | str, invocation: Column, at: Column, node: Column | None = None, category: Column | None = None, correlation: Column | None = None, **attributes: Column) -> list[Column]:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return [
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), invocation.cast("string").alias("invocation_id"), text(correlation if correlation is not None else invocation).alias("correlation_id"),
        text(node).alias("node"), at.alias("at"), text(category).alias("category"), (canonical_json(attributes) if attributes else F.lit("{}")).alias("attributes"),
    ]


def invocation_events(runs: DataFrame, invocation: str, started: str, ended: str, correlation: str | None = None) -> DataFrame:
    """invocation_started and invocation_completed of each run; the latter with its error."""
    who, error = F.col(invocation), F.col("_error")["category"]
    more = {"correlation": F.col(correlation)} if correlation else {}
    first = runs.select(*_event("invocation_started", who, F.col(started), **more))
    return first.unionByName(runs.select(*_event("invocation_completed", who, F.col(ended), F.col("_error")["node"], error, **more, steps=F.col("_step"))))


def node_events(runs: DataFrame, invocation: str, at: Column | None = None) -> DataFrame:
    """node_started and node_completed of each step of traced runs.

    A failure is charged to the node that ran last, also where its outgoing edge failed.
    """
    pairs = path_events(runs, invocation)
    return pairs.select(*_event(F.concat(F.lit("node_"), "phase"), F.col(invocation), at if at is not None else F.lit(None).cast("timestamp"), F.col("node"), F.col("error_category"), step=F.col("step")))


def fan_out_events(runs: DataFrame, invocation: str, node: str, count: Column, at: str, **config) -> DataFrame:
    """A fan-out's configuration and number of instances for each run."""
    return runs.select(*_event("fan_out", F.col(invocation), F.col(at), F.lit(node), item_count=count, **{k: F.lit(v) for k, v in config.items()}))


def branches_events(runs: DataFrame, invocation: str, node: str, names: list[str], at: str, error_policy: str = "fail_fast") -> DataFrame:
    """Parallel branches' configuration for each run."""
    return runs.select(*_event("parallel_branches", F.col(invocation), F.col(at), F.lit(node), branch_count=F.lit(len(names)), branches=F.lit(",".join(names)), error_policy=F.lit(error_policy)))


def save_events(records: DataFrame) -> DataFrame:
    """checkpoint_saved of each record that a run has saved (CheckpointStore.all), at its node."""
    return records.select(
        *_event("checkpoint_saved", F.col("invocation_id"), F.col("last_saved_at"), F.col("node"), correlation=F.col("correlation_id"), seq=F.col("seq"), completed=F.size("completed_positions"))
    )


def branch_events(runs: DataFrame, invocation: str, node: str, shown: Mapping[str, Column], at: str, errors: str | None = None) -> DataFrame:
    """A started and a completed event of each branch that ran, called or subgraph alike.

    shown: by branch, the condition under which it ran (Branch.when; F.lit(True) without
    one). errors: the node's errors_field, whose entries give failed branches their category.
    """
    each = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(k).alias("k"), F.coalesce(when, F.lit(False)).alias("ran")) for k, (name, when) in enumerate(shown.items())))
    ran = runs.withColumn("_b", F.explode(F.filter(each, lambda b: b["ran"])))
    bad = F.lit(None).cast("string")
    if errors is not None:
        bad = F.get(F.transform(F.filter(errors, lambda e: e["branch_name"] == F.col("_b")["name"]), lambda e: e["category"]), F.lit(0))
    both = ran.withColumn("_category", bad).withColumn("_phase", F.explode(F.array(F.lit("started"), F.lit("completed"))))
    category = F.when(F.col("_phase") == "completed", F.col("_category"))
    return both.select(*_event(F.concat(F.lit("branch_"), "_phase"), F.col(invocation), F.col(at), F.concat(F.lit(f"{node}/"), F.col("_b")["name"]), category, index=F.col("_b")["k"]))


def call_events(calls: DataFrame, what: str, invocation: str, at: str, category: str = "category", node: str | None = None, attributes: Mapping[str, str] | None = None) -> DataFrame:
    """An event a provider or tool call: of the kind's own name, or its failed one."""
    good, bad = CALLS[what]
    carried = {k: F.col(c) for k, c in (attributes or {}).items()}
    kind = F.when(F.col(category).isNull(), good).otherwise(bad)
    return calls.select(*_event(kind, F.col(invocation), F.col(at), F.col(node) if node else None, F.col(category), **carried))


def retry_events(calls: DataFrame, invocation: str, at: str, attempts: str = "attempts", reasons: str = "reasons") -> DataFrame:
    """An llm_retry_attempt for each repetition of a completion call, with its reason."""
    each = calls.where(F.col(attempts) > 1).select("*", F.posexplode(F.split(reasons, ",")).alias("_k", "_why")).where(F.col("_k") < F.col(attempts) - 1)
    return each.select(*_event("llm_retry_attempt", F.col(invocation), F.col(at), attempt=F.col("_k") + 1, reason=F.col("_why")))


def tool_scopes(events: DataFrame, invocation: str = "invocation_id", order: str = "seq", kind: str = "kind", node: str = "node", tools: str = "tool") -> DataFrame:
    """Tool events with the node they were called in: the last one that has started before.

    A window over the invocation's events; null before the first node and after its end.
    """
    w = Window.partitionBy(invocation).orderBy(order)
    state = F.when(F.col(kind) == "started", F.struct(F.col(node).alias("node"))).when(F.col(kind) == "completed", F.struct(F.lit(None).cast("string").alias("node")))
    return events.withColumn("scope", F.last(state, ignorenulls=True).over(w)["node"]).where(F.col(kind) == tools)


def with_prompts(calls: DataFrame, prompts: DataFrame, name: str = "prompt") -> DataFrame:
    """Calls with version and hash of the prompt that was active (null: none was)."""
    known = prompts.select(F.col("name").alias(name), F.col("version").alias("prompt_version"), F.col("template_hash").alias("prompt_hash"))
    return calls.join(known, name, "left")


def identified(df: DataFrame, invocation: str, correlation: str | None = None) -> DataFrame:
    """df with the ids that nodes read with current_invocation() and current_correlation();
    without a correlation the invocation is its own."""
    own = F.col(invocation).cast("string")
    return df.withColumns({"_invocation_id": own, "_correlation_id": F.coalesce(F.col(correlation).cast("string"), own) if correlation else own})


def current_invocation() -> Column:
    return F.col("_invocation_id")


def current_correlation() -> Column:
    return F.col("_correlation_id")
