"""Expressions of the event log: buckets, budgets, payload cuts, ids, metadata, lineage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .reducers import map_union

#: Histogram bounds by rule: seconds double from 0.01, tokens grow by powers of four.
DURATION_BOUNDS = tuple(0.01 * 2**k for k in range(14))
TOKEN_BOUNDS = tuple(4**k for k in range(14))
PAYLOAD_CAP, LEAST_CAP = 65536, 256
#: Metadata keys with these beginnings, or (fixed values) of these names, belong to the engine.
RESERVED_PREFIXES = ("flowloom.", "gen_ai.")
RESERVED_KEYS = (
    "correlation_id", "entry_node", "spec_version", "detached_child_trace_ids", "namespace", "step", "attempt_index", "fan_out_index", "subgraph_name",
    "fan_out_item_count", "fan_out_concurrency", "fan_out_error_policy", "fan_out_parent_node_name", "prompt_group_name", "request_extras", "finish_reason",
    "system", "response_model", "response_id", "prompt", "invocation_id", "branch_name", "detached", "detached_from_invocation_id", "implementation_name",
    "implementation_version", "parallel_branches_branch_count", "parallel_branches_error_policy", "parallel_branches_parent_node_name",
)
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def bucket(value: Column, bounds: Sequence[float]) -> Column:
    """Number of bounds below the value: a value on a bound is in the bucket it closes."""
    return F.size(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: b < value))


def is_prefix(part: Column, whole: Column, strict: bool = False) -> Column:
    """Whether a namespace begins another (or equals it)."""
    ok = F.slice(whole, 1, F.greatest(F.size(part), F.lit(1))) == part
    ok = F.when(F.size(part) == 0, F.lit(True)).otherwise(ok & (F.size(whole) >= F.size(part)))
    return ok & (F.size(part) < F.size(whole)) if strict else ok


def truncated(text: Column, cap: int = PAYLOAD_CAP) -> Column:
    """A text of at most cap UTF-8 bytes; a cut one ends in a marker with its full size.

    The cut is moved back to the start of a character, by 3 bytes at most.
    """
    if cap < LEAST_CAP:
        raise ValueError(f"cap must be {LEAST_CAP} or more")
    size = F.octet_length(text)
    marker = F.concat(F.lit("…[truncated, "), size.cast("string"), F.lit(" bytes total]"))
    room = F.lit(cap) - F.octet_length(marker)
    raw = text.cast("binary")

    def starts(back: int) -> Column:
        # a byte 10xxxxxx continues a character
        b = F.conv(F.hex(F.substring(raw, room - back + 1, F.lit(1))), 16, 10).cast("int")
        return b.bitwiseAND(F.lit(0xC0)) != 0x80

    keep = F.when(starts(0), room).when(starts(1), room - 1).when(starts(2), room - 2).otherwise(room - 3)
    return F.when(size <= cap, text).otherwise(F.concat(F.substring(raw, F.lit(1), keep).cast("string"), marker))


def trace_id(invocation: Column) -> Column:
    """A UUID without dashes; of other ids the first 16 bytes of SHA-256, in hex."""
    return F.when(invocation.rlike(UUID), F.lower(F.replace(invocation, F.lit("-"), F.lit("")))).otherwise(F.substring(F.sha2(invocation, 256), 1, 32))


def valid_invocation_id(value: Column) -> Column:
    return value.rlike("^[A-Za-z0-9._~-]+$")


def reserved_key(key: Column, prefixes: Sequence[str] = RESERVED_PREFIXES, names: Sequence[str] = RESERVED_KEYS) -> Column:
    bad = key.isin(*names)
    for p in prefixes:
        bad = bad | key.startswith(p)
    return bad


def merged_metadata(old: Column, new: Column) -> Column:
    """Caller metadata with additions; the later value of a key wins."""
    return map_union(old, new)


def metadata_error(metadata: Column) -> Column:
    """The smallest key that is reserved, or null."""
    return F.array_min(F.filter(F.map_keys(metadata), lambda k: reserved_key(k)))


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """Compact JSON with sorted keys, non-ASCII kept; null fields are left out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def token_budget(prompt: Column, completion: Column, total: Column, input_max: Column, total_max: Column) -> Column:
    """Array of (kind, actual, max, exceeded, ratio): a bound without a count is left out.

    exceeded is strict; the ratio of a zero bound is null.
    """

    def entry(kind: str, actual: Column, most: Column) -> Column:
        made = F.struct(
            F.lit(kind).alias("kind"), actual.cast("long").alias("actual"), most.cast("long").alias("max"),
            (actual > most).alias("exceeded"), F.when(most != 0, actual / most).alias("ratio"),
        )
        return F.when(actual.isNotNull() & most.isNotNull(), made)

    both = F.array(entry("input", prompt, input_max), entry("total", F.coalesce(total, prompt + completion), total_max))
    return F.filter(both, lambda x: x.isNotNull())


def payload(value: Column, shown: bool = False) -> Column:
    """Payloads are hidden unless asked for."""
    return value if shown else F.lit(None).cast("string")


def trace_io(stub: Mapping[str, Column], state: Mapping[str, Column], hook: Column | None = None, shown: bool = False, isolated: bool = True, limit: int | None = None) -> Column:
    """What a trace shows as its input or output, as JSON.

    The caller's hook, where it isn't null; else the whole state, if it is to be shown; else
    a stub of ids, without those that are null. A destination that others share (isolated =
    False) gets the stub whatever else is asked for. `limit` bounds the bytes of what isn't
    the stub.
    """
    least = canonical_json({k: c.cast("string") for k, c in stub.items()})
    if not isolated:
        return least
    own = hook if not shown else F.coalesce(hook, canonical_json(state)) if hook is not None else canonical_json(state)
    if own is None:
        return least
    return F.coalesce(truncated(own, limit) if limit is not None else own, least)


def cause_category(chain: Column) -> Column:
    """Of a chain of (carrier, category, message), outermost first: the first real category."""
    real = F.filter(chain, lambda x: ~x["carrier"] & F.coalesce(x["category"] != "", F.lit(False)))
    return F.get(real, F.lit(0))["category"]


def cause_message(chain: Column) -> Column:
    """The message of the link that cause_category names, else of the first real link."""
    plain = F.filter(chain, lambda x: ~x["carrier"])
    real = F.filter(plain, lambda x: F.coalesce(x["category"] != "", F.lit(False)))
    return F.coalesce(F.get(real, F.lit(0))["message"], F.get(plain, F.lit(0))["message"])


def transient(category: Column, cause: Column | None = None) -> Column:
    """Whether a failure may be retried: by its own category or its immediate cause's."""
    from ..errors import TRANSIENT_CATEGORIES

    ok = F.coalesce(category.isin(*TRANSIENT_CATEGORIES), F.lit(False))
    return ok if cause is None else ok | F.coalesce(cause.isin(*TRANSIENT_CATEGORIES), F.lit(False))


def backoff_bound(attempt: Column, base: float = 1.0, cap: float = 30.0) -> Column:
    """The largest wait before a repetition; the wait itself is uniform below it."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))
