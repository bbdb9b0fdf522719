"""JSON Schemas as native expressions over VARIANT values.

A schema is compiled once, on the driver, to a Column that says what breaks it (null:
nothing). Supported: type (one or several), enum, const, properties, required,
additionalProperties false, items, minItems, maxItems, minimum, maximum, exclusiveMinimum,
exclusiveMaximum, multipleOf, minLength, maxLength, pattern, anyOf, allOf, oneOf, not, and
references to $defs that don't come back to themselves. Others go through the row-wise check
in Python (functions.messages).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .messages import check_schema, structured_output

#: Keywords that carry no rule.
NOTES = frozenset(("$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "format", "$comment", "deprecated", "readOnly", "writeOnly"))
#: Keywords that compile to expressions.
NATIVE = frozenset((
    "type", "enum", "const", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum",
    "multipleOf", "minLength", "maxLength", "pattern", "anyOf", "allOf", "oneOf", "not", "$ref",
))
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class Unsupported(Exception):
    """A schema that can't be put into an expression."""


def _kind(v: Column) -> Column:
    """The JSON type of a VARIANT: null, boolean, number, string, array or object."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.isNull() | (s == "VOID"), "null").otherwise("number")
    )


def _is(v: Column, name: str) -> Column:
    if name == "integer":
        number = F.try_variant_get(v, "$", "double")
        return (_kind(v) == "number") & F.coalesce(number == F.floor(number).cast("double"), F.lit(False))
    if name not in ("null", "boolean", "number", "string", "array", "object"):
        raise Unsupported(f"type {name}")
    return _kind(v) == name


def _equals(v: Column, value) -> Column:
    """Whether a VARIANT is a JSON value; numbers by value, objects whatever their keys' order."""
    if value is None or isinstance(value, bool | str):
        kind = "null" if value is None else "boolean" if isinstance(value, bool) else "string"
        same = F.lit(True) if value is None else F.try_variant_get(v, "$", "boolean" if isinstance(value, bool) else "string") == F.lit(value)
        return (_kind(v) == kind) & F.coalesce(same, F.lit(False))
    if isinstance(value, int | float):
        return (_kind(v) == "number") & F.coalesce(F.try_variant_get(v, "$", "double") == F.lit(float(value)), F.lit(False))
    return F.coalesce(F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value)))), F.lit(False))


def _first(*checks: Column) -> Column:
    return F.coalesce(*checks, F.lit(None).cast("string"))


def _broken(v: Column, schema, root: Mapping, within: tuple[str, ...] = ()) -> Column:
    """What breaks a schema at a VARIANT value, or null. `within` are the references that lead here."""
    if schema is True:
        return F.lit(None).cast("string")
    if schema is False:
        return F.lit("nothing is allowed")
    if unknown := set(schema) - NATIVE - NOTES:
        raise Unsupported(", ".join(sorted(unknown)))
    checks: list[Column] = []
    fail = lambda when, why: checks.append(F.when(F.coalesce(when, F.lit(False)), F.lit(why)))
    sub = lambda value, s: _broken(value, s, root, within)
    if "$ref" in schema:
        if schema["$ref"] in within:
            raise Unsupported("a reference comes back to itself")
        checks.append(_broken(v, _resolved(schema["$ref"], root), root, (*within, schema["$ref"])))
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        ok = F.lit(False)
        for name in names:
            ok = ok | _is(v, name)
        fail(~ok, f"not {' or '.join(names)}")
    if "const" in schema:
        fail(~_equals(v, schema["const"]), "not the constant")
    if "enum" in schema:
        ok = F.lit(False)
        for value in schema["enum"]:
            ok = ok | _equals(v, value)
        fail(~ok, "not in enum")
    number = F.when(_kind(v) == "number", F.try_variant_get(v, "$", "double"))
    for key, breaks in (("minimum", lambda x: number < x), ("maximum", lambda x: number > x), ("exclusiveMinimum", lambda x: number <= x), ("exclusiveMaximum", lambda x: number >= x)):
        if key in schema:
            fail(breaks(float(schema[key])), key)
    if "multipleOf" in schema:
        ratio = number / F.lit(float(schema["multipleOf"]))
        fail(ratio != F.round(ratio), "multipleOf")
    text = F.when(_kind(v) == "string", F.try_variant_get(v, "$", "string"))
    if "minLength" in schema:
        fail(F.char_length(text) < schema["minLength"], "minLength")
    if "maxLength" in schema:
        fail(F.char_length(text) > schema["maxLength"], "maxLength")
    if "pattern" in schema:
        fail(~text.rlike(schema["pattern"]), "pattern")
    items = F.when(_kind(v) == "array", F.try_variant_get(v, "$", "array<variant>"))
    if "minItems" in schema:
        fail(F.size(items) < schema["minItems"], "minItems")
    if "maxItems" in schema:
        fail(F.size(items) > schema["maxItems"], "maxItems")
    if "items" in schema:
        if not isinstance(schema["items"], Mapping | bool):
            raise Unsupported("items as a list")
        bad = F.filter(F.transform(items, lambda x, i: F.concat(i.cast("string"), F.lit(": "), sub(x, schema["items"]))), lambda x: x.isNotNull())
        checks.append(F.get(bad, F.lit(0)))
    is_object = _kind(v) == "object"
    keys = F.when(is_object, F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    for name in schema.get("required", ()):
        fail(~F.array_contains(keys, name), f"{name} is missing")
    for name, own in schema.get("properties", {}).items():
        if not _PLAIN.fullmatch(name):
            raise Unsupported(f"property {name!r}")
        inner = sub(F.try_variant_get(v, f"$.{name}", "variant"), own)
        checks.append(F.when(F.coalesce(F.array_contains(keys, name), F.lit(False)), F.concat(F.lit(f"{name}: "), inner)))
    if "additionalProperties" in schema:
        if schema["additionalProperties"] is False:
            more = F.array_except(keys, F.array(*(F.lit(n) for n in schema.get("properties", {}))).cast("array<string>"))
            fail(F.size(more) > 0, "a property too many")
        elif schema["additionalProperties"] not in (True, {}):
            raise Unsupported("additionalProperties with a schema")
    if "not" in schema:
        fail(sub(v, schema["not"]).isNull(), "what must not match matches")
    for own in schema.get("allOf", ()):
        checks.append(sub(v, own))
    for key, right in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
        if key in schema:
            n = F.lit(0)
            for own in schema[key]:
                n = n + F.when(sub(v, own).isNull(), 1).otherwise(0)
            fail(~right(n), key)
    return _first(*checks)


def _resolved(ref: str, root: Mapping):
    at = root
    if not ref.startswith("#"):
        raise Unsupported(f"reference {ref}")
    for part in filter(None, ref[1:].split("/")):
        part = part.replace("~1", "/").replace("~0", "~")
        if not isinstance(at, Mapping) or part not in at:
            raise Unsupported(f"reference {ref}")
        at = at[part]
    return at


def is_native(schema: Mapping) -> bool:
    """Whether a schema compiles to an expression."""
    try:
        _broken(F.parse_json(F.lit("null")), schema, schema)
    except Unsupported:
        return False
    return True


def schema_check(schema: Mapping) -> Callable[[Column], Column]:
    """From a JSON text to what breaks the schema, or null: `not JSON`, `not an object`, or a rule.

    The text must hold an object, and no object may have a key twice. Schemas with keywords beyond the native ones, or whose
    references come back to themselves, are checked by the row-wise function instead.
    """
    check_schema(schema)
    if not is_native(schema):
        row_wise = structured_output(schema)
        return lambda text: row_wise(text)["reason"]

    def check(text: Column) -> Column:
        v = F.try_parse_json(text)
        return F.when(v.isNull(), "not JSON").when(_kind(v) != "object", "not an object").otherwise(_broken(v, schema, schema))

    return check
