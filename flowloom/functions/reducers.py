"""Merge rules of state fields, as expressions over a prior value and an update.

`merge` is for updates of one row; the `fold_*` functions are the same rules over many
update rows of a key, as aggregates with partial results before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_union(first: Column, second: Column) -> Column:
    """Entries of both maps; where a key is in both, the second's value. Any map policy."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k)), second)


def _null(*values: Column) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | v.isNull()
    return out


@dataclass(frozen=True)
class Reducer:
    """name; merge(prior, update); bad(prior, update): whether the merge is a reducer_error.

    round_trip_idempotent says whether merging a value into itself changes nothing.
    """

    name: str
    merge: Callable[[Column, Column], Column]
    bad: Callable[[Column, Column], Column] = lambda prior, update: F.lit(False)
    round_trip_idempotent: bool | None = None


LAST_WRITE_WINS = Reducer("last_write_wins", lambda p, u: u, round_trip_idempotent=True)
APPEND = Reducer("append", lambda p, u: F.concat(p, u), _null, False)
MERGE = Reducer("merge", map_union, _null, True)
CONCAT_FLATTEN = Reducer(
    "concat_flatten", lambda p, u: F.concat(p, F.flatten(u)), lambda p, u: _null(p, u) | F.exists(u, lambda x: x.isNull()), False
)
MERGE_ALL = Reducer(
    "merge_all", lambda p, u: F.aggregate(u, p, map_union), lambda p, u: _null(p, u) | F.exists(u, lambda x: x.isNull()), False
)
REDUCERS = {r.name: r for r in (LAST_WRITE_WINS, APPEND, MERGE, CONCAT_FLATTEN, MERGE_ALL)}


def merged(reducer: Reducer, prior: Column, update: Column, error: Column | None = None) -> tuple[Column, Column]:
    """The merged value, and whether it failed; a failed merge keeps the prior value."""
    bad = F.coalesce(reducer.bad(prior, update), F.lit(False))
    return F.when(bad, prior).otherwise(reducer.merge(prior, update)), bad


def fold_last(value: Column, *order: Column | str) -> Column:
    """The value of the last update, even a null one."""
    return F.max_by(F.struct(value.alias("v")), F.struct(*order))["v"]


def fold_append(value: Column, *order: Column | str) -> Column:
    """All values in order, nulls kept; the values' type must be orderable (no map)."""
    rows = F.collect_list(F.struct(F.struct(*order).alias("o"), value.alias("v")))
    return F.transform(F.array_sort(rows), lambda x: x["v"])


def fold_concat(value: Column, *order: Column | str) -> Column:
    """Elements of all list values, in order."""
    return F.flatten(fold_append(value, *order))


def fold_merge(value: Column, *order: Column | str) -> Column:
    """Entries of all map values in one map, later ones winning; for maps of bounded size.

    For a key column and a value column group by the key as well and use fold_last: no map
    is gathered then.
    """
    maps = F.transform(fold_append(F.map_entries(value), *order), F.map_from_entries)
    return F.aggregate(F.slice(maps, F.lit(2), F.size(maps)), F.get(maps, F.lit(0)), map_union)
