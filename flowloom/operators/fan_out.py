"""Fan-out whose instances are rows, for work that isn't an expression (a provider client,
a model), and the ordered fan-in after it.

Where the instance is an expression, a graph's fan-out node needs none of this: it maps the
item array in place and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exploded(rows: DataFrame, items: str, item: str = "item", index: str = "fan_out_index") -> DataFrame:
    """A row for each item; rows without items vanish here and come back in the fan-in."""
    return rows.select("*", F.posexplode(items).alias(index, item))


def gathered(instances: DataFrame, key: str, outputs: Mapping[str, str], index: str = "fan_out_index", failed: str | None = None) -> DataFrame:
    """Per key: each output's values in instance order (nulls kept), n_instances, n_failed.

    Failed instances are left out of the lists. A key's instances meet in one task, as its
    result is one row; partial lists are built before the shuffle.
    """
    ok = F.lit(True) if failed is None else ~F.coalesce(F.col(failed), F.lit(False))
    one = F.when(ok, F.struct(F.col(index).alias("i"), *(F.col(c).alias(p) for p, c in outputs.items())))
    g = instances.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("_r"), F.count("*").alias("n_instances"), F.count(F.when(~ok, 1)).alias("n_failed"))
    return g.select(key, *(F.col(f"_r.{p}").alias(p) for p in outputs), "n_instances", "n_failed")


def mapped(rows: DataFrame, key: str, items: str, child: Callable[[DataFrame], DataFrame], outputs: Mapping[str, str], failed: str | None = None, parallelism: int | None = None) -> DataFrame:
    """rows with the outputs of child over every item, in item order; empty lists for none."""
    inst = exploded(rows.select(key, items), items)
    inst = inst if parallelism is None else inst.repartition(parallelism)
    got = gathered(child(inst), key, outputs, failed=failed)
    out = rows.join(got, key, "left")
    return out.withColumns({**{p: F.coalesce(F.col(p), F.array()) for p in outputs}, "n_instances": F.coalesce("n_instances", F.lit(0)), "n_failed": F.coalesce("n_failed", F.lit(0))})


def resumed(rows: DataFrame, key: str, items: str, saved: DataFrame, child: Callable[[DataFrame], DataFrame], outputs: Mapping[str, str]) -> DataFrame:
    """A fan-out that was broken off: completed instances roll forward, the others run.

    saved: key, fan_out_index and the child's output columns, a row for each completed
    instance. Only instances without a saved row go through child. A saved index beyond the
    items means that the number of instances has changed: `changed` marks such rows.
    """
    inst = exploded(rows.select(key, items), items)
    at = [key, "fan_out_index"]
    fresh = child(inst.join(saved.select(*at), at, "left_anti"))
    both = fresh.select(*at, *outputs.values()).unionByName(saved.select(*at, *outputs.values()))
    got = gathered(both, key, outputs)
    out = rows.join(got, key, "left")
    return out.withColumns(
        {**{p: F.coalesce(F.col(p), F.array()) for p in outputs}, "changed": F.coalesce(F.col("n_instances"), F.lit(0)) != F.size(F.coalesce(F.col(items), F.array()))}
    )
