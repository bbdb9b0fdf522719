"""JSON Schemas as expressions, against the row-wise check."""

import json
import random

import pytest
from pyspark.sql import functions as F

from flowloom.errors import ProviderError
from flowloom.functions.json_schema import is_native, schema_check
from flowloom.functions.messages import schema_violation

SCHEMAS = [
    {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": ["string", "null"], "minLength": 2, "maxLength": 4}}, "required": ["a"]},
    {"type": "object", "properties": {"a": {"enum": [1, "x", None, True]}, "b": {"const": {"k": [1]}}}, "additionalProperties": False},
    {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "number", "minimum": 0, "exclusiveMaximum": 3}, "minItems": 1, "maxItems": 2}}},
    {"type": "object", "properties": {"a": {"anyOf": [{"type": "string", "pattern": "^x"}, {"type": "number", "multipleOf": 0.5}]}, "b": {"oneOf": [{"type": "integer"}, {"type": "number"}]}}},
    {"type": "object", "properties": {"a": {"$ref": "#/$defs/d"}, "b": {"not": {"type": "string"}}}, "$defs": {"d": {"type": "object", "properties": {"k": {"type": "boolean"}}, "required": ["k"], "additionalProperties": False}}},
    {"type": "object", "allOf": [{"required": ["a"]}, {"properties": {"b": {"type": "boolean"}}}], "title": "t"},
]
LEAVES = [0, 1, 2.5, -1, 3, 1e2, 1.0, "x", "xy", "long text", "", None, True, False, [], [1], [1, 2, 3], [0.5, "x"], {}, {"k": [1]}, {"k": True}, {"k": True, "z": 1}, {"k": "t"}, "é日"]


def values():
    r = random.Random(5)
    out = [{}, *({"a": x} for x in LEAVES), *({"b": x} for x in LEAVES), *({"a": r.choice(LEAVES), "b": r.choice(LEAVES)} for _ in range(60)), {"a": 1, "c": 2}]
    return [json.dumps(v, ensure_ascii=False) for v in out] + ["[1]", "null", "3", '"x"', "", "not json", '{"a": 1', None]


@pytest.mark.parametrize("k", range(len(SCHEMAS)))
def test_expressions_agree_with_the_row_wise_check(spark, k):
    schema, texts = SCHEMAS[k], values()
    assert is_native(schema)
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", schema_check(schema)(F.col("t")).alias("bad")).orderBy("i").select("bad").collect()]
    for t, bad in zip(texts, got, strict=True):
        try:
            value = json.loads(t) if t is not None else ...
        except ValueError:
            value = ...
        if not isinstance(value, dict):
            assert bad == ("not JSON" if value is ... else "not an object"), t
        else:
            assert (bad is None) == (schema_violation(value, schema) is None), (t, bad)


def test_reasons_name_the_place_and_the_plan_has_no_python(spark):
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "integer"}}}}}, "required": ["a"]}
    df = spark.createDataFrame([('{"a": [{"n": 1}, {"n": "x"}]}',), ("{}",)], "t string").select(schema_check(schema)(F.col("t")).alias("bad"))
    assert [r["bad"] for r in df.collect()] == ["a: 1: n: not integer", "a is missing"]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_other_schemas_go_row_by_row(spark):
    node = {"type": "object", "properties": {"next": {"$ref": "#/$defs/node"}, "n": {"type": "integer"}}}
    tree = {"type": "object", "properties": {"next": {"$ref": "#/$defs/node"}}, "$defs": {"node": node}}
    assert not is_native(tree) and not is_native({"type": "object", "patternProperties": {"^x": {}}})
    df = spark.createDataFrame([('{"next": {"n": 1}}',), ('{"next": {"next": {"n": "x"}}}',)], "t string")
    assert [r[0] is None for r in df.select(schema_check(tree)(F.col("t"))).collect()] == [True, False]
    with pytest.raises(ProviderError):
        schema_check({"type": "array"})
