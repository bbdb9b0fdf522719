"""Compile checks, projections, migrations and managed request bodies: no Spark work."""

import warnings

import pytest

from flowloom.errors import CheckpointError, FlowError, ProviderError
from flowloom.functions import messages as M
from flowloom.functions import retrieval as V
from flowloom.functions.reducers import APPEND, MERGE
from flowloom.plans.graph import END, Branch, Explicit, FanOut, GraphBuilder, Migration, Migrations, RoundTripWarning, SameName, projection
from flowloom.plans.schema import Field, StateSchema, invalid_fields

S = StateSchema({"a": Field("bigint"), "xs": Field("array<bigint>", reducer=APPEND)})
nothing = lambda s: {}


def child():
    return GraphBuilder(S).add_node("n", nothing).add_edge("n", END).set_entry("n").compile()


def category(fn):
    with pytest.raises(FlowError) as e:
        fn()
    return e.value.category


def test_compile_checks():
    b = lambda: GraphBuilder(S).add_node("n", nothing)
    assert category(lambda: b().add_edge("n", END).compile()) == "no_declared_entry"
    assert category(lambda: b().set_entry("x").compile()) == "dangling_edge"
    assert category(lambda: b().add_edge("n", "x").set_entry("n").compile()) == "dangling_edge"
    assert category(lambda: b().add_edge("x", "n").set_entry("n").compile()) == "dangling_edge"
    assert category(lambda: b().add_edge("n", END).add_edge("n", "n").set_entry("n").compile()) == "multiple_outgoing_edges"
    assert category(lambda: b().add_node("m", nothing).add_edge("n", END).set_entry("n").compile()) == "unreachable_node"
    two = StateSchema({"a": Field("bigint", reducer=(APPEND, MERGE))})
    assert category(lambda: GraphBuilder(two).add_node("n", nothing).set_entry("n").compile()) == "conflicting_reducers"
    with pytest.raises(ValueError):
        b().add_node("n", nothing)
    # an open choice may reach every node
    assert b().add_node("m", nothing).add_conditional_edge("n", nothing).add_edge("m", END).set_entry("n").compile().order() is None


def test_compile_checks_come_in_order():
    two = StateSchema({"a": Field("bigint", reducer=(APPEND, MERGE))})
    assert category(lambda: GraphBuilder(two).compile()) == "conflicting_reducers"
    g = GraphBuilder(S).add_subgraph("s", child(), Explicit({"nope": "a"}))
    assert category(g.compile) == "mapping_references_undeclared_field"


def test_projection_forms():
    assert category(lambda: projection(inputs={"a": "a"}, into=["a"])) == "conflicting_projection_forms"
    assert isinstance(projection(into=["a"]), SameName) and isinstance(projection(outputs={}), Explicit)
    assert Explicit({}, None).outward(S, S) == {"a": "a", "xs": "xs"} and Explicit({}, {}).outward(S, S) == {}


def test_fan_out_and_branch_specs():
    b = lambda: GraphBuilder(S)
    assert category(lambda: b().add_fan_out("f", FanOut(child(), "xs", "a"))) == "fan_out_count_mode_ambiguous"
    assert category(lambda: b().add_fan_out("f", FanOut(child(), "xs", "a", items_field="xs", count=2))) == "fan_out_count_mode_ambiguous"
    assert category(lambda: b().add_fan_out("f", FanOut(child(), "xs", "a", items_field="a"))) == "fan_out_field_not_list"
    assert category(lambda: b().add_fan_out("f", FanOut(child(), "xs", "zz", count=1))) == "mapping_references_undeclared_field"
    assert category(lambda: b().add_fan_out("f", FanOut(child(), "xs", "a", count=1, degraded={"xs": []}))) == "fan_out_degraded_update_missing_collect_field"
    assert category(lambda: b().add_branches("b", {})) == "parallel_branches_no_branches"
    assert category(lambda: b().add_branches("b", {"x": Branch()})) == "parallel_branches_invalid_branch_spec"
    assert category(lambda: b().add_branches("b", {"x": Branch(graph=child(), call=nothing)})) == "parallel_branches_invalid_branch_spec"


def test_round_trip_warns_after_all_checks():
    g = GraphBuilder(S).add_subgraph("s", child(), SameName(("xs",), ("xs",))).add_edge("s", END).set_entry("s")
    with pytest.warns(RoundTripWarning):
        g.compile()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        GraphBuilder(S).add_subgraph("s", child(), SameName(("a",), ("a",))).add_edge("s", END).set_entry("s").compile()


def test_migration_chains():
    m = lambda a, b: Migration(a, b, nothing)
    reg = Migrations([m("1", "2"), m("2", "3"), m("1", "3"), m("", "1")])
    assert [(x.source, x.target) for x in reg.chain("1", "3")] == [("1", "3")]
    assert [(x.source, x.target) for x in reg.chain("", "3")] == [("", "1"), ("1", "3")]
    assert reg.chain("3", "3") == []
    with pytest.raises(CheckpointError, match="missing"):
        reg.chain("3", "1")
    with pytest.raises(CheckpointError, match="ambiguous"):
        reg.add(m("1", "2"))
    with pytest.raises(ValueError):
        reg.add(m("1", ""))
    with pytest.raises(CheckpointError, match="ambiguous"):
        Migrations([m("a", "b"), m("a", "c"), m("b", "d"), m("c", "d")]).chain("a", "d")
    with pytest.raises(CheckpointError):
        reg.add_all([m("3", "4"), m("1", "2")])
    assert category(lambda: reg.chain("3", "4")) == "checkpoint_state_migration_missing"  # nothing was added


def test_invalid_fields():
    assert invalid_fields({"a": "string", "xs": "array<bigint>", "other": "int"}, S) == ["a"]


def test_managed_extras():
    body = {"model": "m", "stop": ["a", "b", "a"]}
    got = V.managed_extras(body, {"stop": ["b", "c", "c"], "user": 1, "model": "m"}, {"model": "reject", "stop": "merge"})
    assert got == {"model": "m", "stop": ["a", "b", "a", "c"], "user": 1}
    with pytest.raises(ProviderError):
        V.managed_extras(body, {"model": "n"}, {"model": "reject"})
    with pytest.raises(ValueError):
        V.managed_extras(body, {"model": "n"}, {})


def test_stitched_responses():
    r = lambda n, tokens: {"id": "x", "model": "m", "vectors": [[1.0]] * n, "tokens": tokens}
    assert V.stitched([r(2, 3), r(1, 4)], 2)["tokens"] == 7 and V.stitched([r(2, 3), r(1, None)], 2)["tokens"] is None
    with pytest.raises(ProviderError):
        V.stitched([r(1, 3), r(1, 4)], 2)


def test_base_urls():
    assert V.normalized_base_url("http://h//") == "http://h"
    with pytest.raises(ValueError):
        V.normalized_base_url("http://h/v1/")


def test_tools_and_schemas():
    M.check_tools(["a", "b"], {"name": "a"})
    for names, choice in ((["a", "a"], None), ([], "required"), (["a"], {"name": "z"})):
        with pytest.raises(ProviderError):
            M.check_tools(names, choice)
    M.check_schema({"type": "object", "properties": {"x": {"$ref": "#/$defs/y"}}, "$defs": {"y": {"type": "string"}}})
    for bad in ({"type": "array"}, {"type": "object", "properties": {"x": {"$ref": "#/$defs/z"}}}):
        with pytest.raises(ProviderError):
            M.check_schema(bad)
    closed = {"type": "object", "properties": {"x": {"type": "string"}}, "required": ["x"], "additionalProperties": False}
    assert M.strict_supported(closed) and not M.strict_supported({**closed, "required": []})


def test_schema_violations():
    s = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}, "xs": {"type": "array", "items": {"enum": ["a"]}}}, "required": ["n"], "additionalProperties": False}
    assert M.schema_violation({"n": 1, "xs": ["a"]}, s) is None
    for bad in ({}, {"n": True}, {"n": 0}, {"n": 1, "xs": ["b"]}, {"n": 1, "y": 2}, [], {"n": "1"}):
        assert M.schema_violation(bad, s)


def test_more_schema_keywords():
    check = M.schema_violation
    for schema, good, bad in (
        ({"const": 1}, [1, 1.0], [True, "1", 2]), ({"enum": [1, "a"]}, [1, "a"], [True, None]), ({"oneOf": [{"type": "integer"}, {"minimum": 5}]}, [3, 5.5], [7, 2.5]),
        ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, [1, 3], [0, 4]), ({"not": {"type": "string"}}, [1], ["a"]), ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 2}}, ["ab", 2], ["a", 1]),
        ({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, [2], [1, 3]), ({"multipleOf": 0.1}, [0.3, 2], [0.25]), ({"pattern": "^a+$"}, ["aa", 3], ["ab"]),
        ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, [[1], [1, True]], [[], [1, 1], [1, 2, 3]]), ({"contains": {"const": 1}}, [[0, 1]], [[0]]),
        ({"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, [["a", 1], []], [[1], ["a", "b"]]), ({"minProperties": 1, "maxProperties": 1}, [{"a": 1}], [{}, {"a": 1, "b": 2}]),
        ({"patternProperties": {"^n": {"type": "integer"}}, "additionalProperties": False}, [{"n1": 1}], [{"n1": "x"}, {"x": 1}]), ({"additionalProperties": {"type": "string"}}, [{"a": "b"}], [{"a": 1}]),
    ):
        assert all(check(v, schema) is None for v in good), schema
        assert all(check(v, schema) for v in bad), schema
