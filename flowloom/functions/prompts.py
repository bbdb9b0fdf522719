"""Prompts: labels, hashes, fallback among sources, rendering, groups."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRODUCTION = "production"
VARIABLE = r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"


def resolved_label(explicit: Column, name: Column, labels: Mapping[str, str]) -> Column:
    """Explicit, else the name's, else the entry "default", else production."""
    own = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)) if labels else F.create_map().cast("map<string,string>")
    return F.coalesce(explicit, F.element_at(own, name), F.lit(labels.get("default")), F.lit(PRODUCTION))


def effective_ttl(per_call: Column, default: float | None) -> Column:
    """The call's time to live before the manager's; a negative one is refused (null)."""
    ttl = F.coalesce(per_call, F.lit(default))
    return F.when(ttl >= 0, ttl)


def template_hash(template: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(template, 256))


def version(template: Column) -> Column:
    """The first 16 hex digits of the template's hash."""
    return F.substring(F.sha2(template, 256), 1, 16)


def rendered(template: Column, variables: Column) -> Column:
    """A template with {{ name }} replaced from a map; undefined names are left (see undefined).

    Only plain variables: no filters, blocks or expressions.
    """
    # the pieces between variables and the variables alternate
    names = F.regexp_extract_all(template, F.lit(VARIABLE), F.lit(1))
    whole = F.regexp_extract_all(template, F.lit(VARIABLE), F.lit(0))
    pieces = F.split(template, VARIABLE, -1)
    values = F.zip_with(names, whole, lambda n, w: F.coalesce(F.element_at(variables, n), w))
    return F.array_join(F.flatten(F.zip_with(pieces, values, lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")


def undefined(template: Column, variables: Column) -> Column:
    """Names that the template uses and the map lacks, sorted; a render error if any."""
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(VARIABLE), F.lit(1)))
    return F.array_sort(F.filter(names, lambda n: ~F.map_contains_key(variables, n)))


def chat(segments: Column, variables: Column, injected: Column, text: Callable[[Column], Column] | None = None) -> Column:
    """Messages of a chat prompt: segment (role, template, placeholder) in order.

    `text` renders a segment's template (templates.Dispatcher.text, for blocks and filters);
    without it plain variables are filled in. A placeholder brings its list of messages from the map `injected`; a missing one, an
    empty text or no message at all make the whole null.
    """

    def one(s: Column) -> Column:
        said = rendered(s["template"], variables) if text is None else text(s["template"])
        own = F.when(F.coalesce(said != "", F.lit(False)), F.array(F.struct(s["role"].alias("role"), said.alias("content"))))
        return F.when(s["placeholder"].isNotNull(), F.element_at(injected, s["placeholder"])).otherwise(own)

    parts = F.transform(segments, one)
    out = F.flatten(parts)
    return F.when(F.exists(parts, lambda p: p.isNull()) | (F.size(out) == 0), F.lit(None)).otherwise(out)


def rendered_hash(role: Column, content: Column) -> Column:
    """Hash of one message's canonical JSON: sorted keys, compact, non-ASCII kept."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.array(F.struct(content.alias("content"), role.alias("role")))), 256))


def fetched(candidates: DataFrame, key: str, order: str = "backend_ord", status: str = "status") -> DataFrame:
    """Per key: the first source that isn't unavailable decides, even by not_found.

    If all are unavailable the status is prompt_store_unavailable. One aggregation with
    partial results.
    """
    usable = F.col(status) != "unavailable"
    rest = [c for c in candidates.columns if c not in (key, order, status)]
    first = F.min(F.when(usable, F.struct(order, status, *rest)))
    out = candidates.groupBy(key).agg(first.alias("_w"))
    return out.select(key, F.coalesce(F.col(f"_w.{status}"), F.lit("prompt_store_unavailable")).alias(status), F.col(f"_w.{order}").alias(order), *(F.col(f"_w.{c}").alias(c) for c in rest))


def groups(members: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Sizes of prompt groups and whether each is valid."""
    return members.groupBy(key).agg(F.count("*").alias("n_members")).withColumn("valid", F.col("n_members") >= least)


SAMPLING_KEYS = ("temperature", "top_p", "max_tokens", "seed", "presence_penalty", "frequency_penalty")


def sidecar(config: Column) -> Column:
    """Sampling settings of a JSON sidecar (top level before "extras") and its token budget."""
    one = lambda k: F.coalesce(F.get_json_object(config, f"$.{k}"), F.get_json_object(config, f"$.extras.{k}")).try_cast("double").alias(k)
    return F.struct(
        *(one(k) for k in SAMPLING_KEYS), F.get_json_object(config, "$.token_budget.input_max_tokens").try_cast("long").alias("input_max_tokens"),
        F.get_json_object(config, "$.token_budget.total_max_tokens").try_cast("long").alias("total_max_tokens"),
    )
