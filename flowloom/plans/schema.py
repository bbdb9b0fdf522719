"""State schemas: named fields with types, defaults and merge rules."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CompileError, FlowError
from ..functions.reducers import LAST_WRITE_WINS, Reducer


#: Other names of types.
_SYNONYMS = {"long": "bigint", "integer": "int", "short": "smallint", "byte": "tinyint", "real": "float", "dec": "decimal", "numeric": "decimal"}


def plain_type(ddl: str) -> str:
    """A DDL type in one spelling, without a session: small letters, no blanks, one name each."""
    return re.sub(r"[a-z_]+(?=$|[>,(])", lambda m: _SYNONYMS.get(m.group(), m.group()), re.sub(r"\s+", "", ddl.lower()))


@dataclass(frozen=True)
class Field:
    """type: a DDL type; default: a Python value or Column; several reducers are a conflict."""

    type: str
    default: Any = None
    reducer: Reducer | tuple[Reducer, ...] | None = None
    required: bool = False

    @property
    def reducers(self) -> tuple[Reducer, ...]:
        if self.reducer is None:
            return ()
        return self.reducer if isinstance(self.reducer, tuple) else (self.reducer,)

    def is_list(self) -> bool:
        return plain_type(self.type).startswith("array<")

    def initial(self) -> Column:
        d = self.default
        if isinstance(d, Column):
            return d.cast(self.type)
        if isinstance(d, list):
            return F.array(*(F.lit(x) for x in d)).cast(self.type)
        if isinstance(d, Mapping):
            return F.create_map(*(F.lit(x) for kv in d.items() for x in kv)).cast(self.type)
        return F.lit(d).cast(self.type)


@dataclass(frozen=True)
class StateSchema:
    fields: Mapping[str, Field]
    version: str = ""
    reserved: tuple[str, ...] = field(default=("_id", "_at", "_error", "_step", "_path", "_run"), repr=False)

    def __post_init__(self):
        for name in self.fields:
            if name in self.reserved:
                raise ValueError(f"{name} is a reserved column")

    def check_reducers(self) -> None:
        for name, f in self.fields.items():
            if len(f.reducers) > 1:
                raise CompileError("conflicting_reducers", f"field {name} has several merge rules", name)

    def reducer(self, name: str) -> Reducer:
        own = self.fields[name].reducers
        return own[0] if own else LAST_WRITE_WINS

    def initial_state(self, df: DataFrame, **values: Column | str) -> DataFrame:
        """df with the schema's columns: those given, those df has, else the defaults.

        Unknown fields and missing required ones are state_validation_error.
        """
        unknown = sorted(set(values) - set(self.fields))
        missing = sorted(n for n, f in self.fields.items() if f.required and n not in values and n not in df.columns)
        if unknown or missing:
            raise FlowError("state_validation_error", f"unknown {unknown}, missing {missing}", ",".join([*unknown, *missing]))
        made = {}
        for name, f in self.fields.items():
            if name in values:
                v = values[name]
                made[name] = (F.col(v) if isinstance(v, str) else v).cast(f.type)
            elif name in df.columns:
                made[name] = F.col(name).cast(f.type)
            else:
                made[name] = f.initial()
        return df.withColumns(made)


def invalid_fields(df_types: Mapping[str, str], schema: StateSchema) -> list[str]:
    """Names, sorted, whose column type can't be the field's; for checks before a run."""
    return sorted(n for n, t in df_types.items() if n in schema.fields and plain_type(t) != plain_type(schema.fields[n].type))
