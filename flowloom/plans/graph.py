"""Graph declaration and compilation: nodes, edges, projections, checks.

No Spark work happens here: what a graph does is decided and checked before any DataFrame.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column

from ..errors import CheckpointError, CompileError
from .schema import StateSchema

#: The target of an edge that ends the run; no node can have this name.
END = "__end__"

#: A node: from the state's columns by name to a partial update. A value is a Column, or
#: Write(column, when) for a field that only some rows write; Fail(when, message) fails rows.
State = Mapping[str, Column]
NodeFunction = Callable[[State], Mapping[str, Any]]


@dataclass(frozen=True)
class Write:
    """An update that is present only where `when` holds; elsewhere the field is absent."""

    value: Column
    when: Column


@dataclass(frozen=True)
class Fail:
    """Under the key "!": rows where `when` holds fail with node_exception."""

    when: Column
    message: str | Column = "failed"
    category: str = "node_exception"


# ------------------------------------------------------------------ projections


@dataclass(frozen=True)
class NameMatching:
    """Nothing goes in; every field that both schemas have comes out."""

    def inward(self, parent: StateSchema, child: StateSchema) -> dict[str, str]:
        return {}

    def outward(self, parent: StateSchema, child: StateSchema) -> dict[str, str]:
        return {n: n for n in parent.fields if n in child.fields}

    def check(self, parent: StateSchema, child: StateSchema) -> None:
        pass


def _declared(names: Sequence[str], schema: StateSchema, side: str) -> None:
    for n in names:
        if n not in schema.fields:
            raise CompileError("mapping_references_undeclared_field", f"{side} has no field {n}", n)


@dataclass(frozen=True)
class Explicit:
    """inputs: child field <- parent field; outputs: parent field <- child field.

    outputs None falls back to name matching; {} takes nothing out.
    """

    inputs: Mapping[str, str] = field(default_factory=dict)
    outputs: Mapping[str, str] | None = None

    def inward(self, parent, child):
        return dict(self.inputs)

    def outward(self, parent, child):
        return NameMatching().outward(parent, child) if self.outputs is None else dict(self.outputs)

    def check(self, parent, child):
        _declared(list(self.inputs), child, "child")
        _declared(list(self.inputs.values()), parent, "parent")
        _declared(list(self.outputs or {}), parent, "parent")
        _declared(list((self.outputs or {}).values()), child, "child")


@dataclass(frozen=True)
class SameName:
    """Fields that go in and fields that come out, each under one name; never falls back."""

    into: Sequence[str] = ()
    out: Sequence[str] = ()

    def inward(self, parent, child):
        return {n: n for n in self.into}

    def outward(self, parent, child):
        return {n: n for n in self.out}

    def check(self, parent, child):
        for names in (self.into, self.out):
            _declared(names, parent, "parent")
            _declared(names, child, "child")


def projection(inputs=None, outputs=None, into=None, out=None):
    """One of the projections, from the forms a node declares; both forms are a conflict."""
    if (inputs is not None or outputs is not None) and (into is not None or out is not None):
        raise CompileError("conflicting_projection_forms", "renames and same-name sets on one node")
    if into is not None or out is not None:
        return SameName(tuple(into or ()), tuple(out or ()))
    if inputs is not None or outputs is not None:
        return Explicit(dict(inputs or {}), outputs)
    return NameMatching()


class RoundTripWarning(UserWarning):
    """A field goes into a child and comes back through a rule that isn't idempotent."""


# ------------------------------------------------------------------ nodes


@dataclass(frozen=True)
class Node:
    name: str
    kind: str  # function, subgraph, fan_out, branches
    run: Any
    middleware: tuple = ()


@dataclass(frozen=True)
class Subgraph:
    graph: CompiledGraph
    projection: Any


@dataclass(frozen=True)
class FanOut:
    """Data parallelism: one instance of a child graph per item, or per count.

    items_field or count (int or function of state) gives the instances; collect_field of
    each, in instance order, goes to target_field through its rule, as do extra_outputs
    (parent <- child). inputs: child <- parent, alike for all instances. With flushes and a
    checkpoint store, finished instances are saved in so many jobs while the node runs.
    """

    graph: CompiledGraph
    target_field: str
    collect_field: str
    items_field: str | None = None
    item_field: str | None = None
    count: int | Callable[[State], Column] | None = None
    inputs: Mapping[str, str] = field(default_factory=dict)
    extra_outputs: Mapping[str, str] = field(default_factory=dict)
    error_policy: str = "fail_fast"
    errors_field: str | None = None
    count_field: str | None = None
    on_empty: str = "raise"
    concurrency: int | Callable[[State], Column] | None = 10
    degraded: Mapping[str, Any] | None = None
    flushes: int | None = None


@dataclass(frozen=True)
class Branch:
    """Either a child graph with its projection, or call: parent state -> partial update."""

    graph: CompiledGraph | None = None
    call: NodeFunction | None = None
    inputs: Mapping[str, str] = field(default_factory=dict)
    outputs: Mapping[str, str] | None = None
    when: Callable[[State], Column] | None = None


@dataclass(frozen=True)
class Branches:
    branches: Mapping[str, Branch]
    error_policy: str = "fail_fast"
    errors_field: str | None = None


@dataclass(frozen=True)
class Edge:
    source: str
    target: str | None = None
    choose: Callable[[State], Column] | None = None
    targets: tuple[str, ...] | None = None  # declared targets of a choice; None: any node


# ------------------------------------------------------------------ migrations


@dataclass(frozen=True)
class Migration:
    """From one schema version to another: state columns by name -> state columns by name."""

    source: str
    target: str
    apply: Callable[[State], Mapping[str, Any]]


class Migrations:
    """Registered steps and the one shortest chain between two versions."""

    def __init__(self, steps: Sequence[Migration] = ()):
        self._steps: dict[tuple[str, str], Migration] = {}
        for s in steps:
            self.add(s)

    def add(self, step: Migration) -> None:
        if not step.target:
            raise ValueError("a migration needs a target version")
        if (step.source, step.target) in self._steps:
            raise CheckpointError("checkpoint_state_migration_chain_ambiguous", f"{step.source!r} to {step.target!r} twice")
        self._steps[step.source, step.target] = step

    def add_all(self, steps: Sequence[Migration]) -> None:
        """All or none."""
        trial = Migrations(list(self._steps.values()))
        for s in steps:
            trial.add(s)
        self._steps = trial._steps

    def sources(self) -> list[str]:
        return list(dict.fromkeys(a for a, _ in self._steps))

    def chain(self, source: str, target: str) -> list[Migration]:
        """The shortest chain; none, or several of that length, are errors."""
        if source == target:
            return []
        paths: dict[str, list[list[Migration]]] = {source: [[]]}
        seen = {source}
        while paths:
            if target in paths:
                if len(paths[target]) > 1:
                    raise CheckpointError("checkpoint_state_migration_chain_ambiguous", f"{len(paths[target])} chains from {source!r} to {target!r}")
                return paths[target][0]
            reached: dict[str, list[list[Migration]]] = {}
            for (a, b), step in self._steps.items():
                for path in paths.get(a, []) if b not in seen else []:
                    reached.setdefault(b, []).append([*path, step])
            seen |= set(reached)
            paths = reached
        raise CheckpointError("checkpoint_state_migration_missing", f"no chain from {source!r} to {target!r}")


# ------------------------------------------------------------------ builder


class GraphBuilder:
    def __init__(self, schema: StateSchema):
        self.schema = schema
        self._nodes: dict[str, Node] = {}
        self._edges: list[Edge] = []
        self._entry: str | None = None
        self._middleware: list = []
        self._migrations = Migrations()
        self._checkpoints: Any = None

    def _add(self, node: Node) -> GraphBuilder:
        if node.name in self._nodes or node.name == END:
            raise ValueError(f"there is a node {node.name} already")
        self._nodes[node.name] = node
        return self

    def add_node(self, name: str, fn: NodeFunction, middleware: Sequence = ()) -> GraphBuilder:
        return self._add(Node(name, "function", fn, tuple(middleware)))

    def add_subgraph(self, name: str, graph: CompiledGraph, projection: Any = None, middleware: Sequence = ()) -> GraphBuilder:
        return self._add(Node(name, "subgraph", Subgraph(graph, projection or NameMatching()), tuple(middleware)))

    def add_fan_out(self, name: str, spec: FanOut, middleware: Sequence = ()) -> GraphBuilder:
        if (spec.items_field is None) == (spec.count is None):
            raise CompileError("fan_out_count_mode_ambiguous", "either items_field or count", name)
        parent, child = self.schema.fields, spec.graph.schema.fields
        if spec.items_field is not None:
            _declared([spec.items_field], self.schema, "parent")
            if not parent[spec.items_field].is_list():
                raise CompileError("fan_out_field_not_list", f"{spec.items_field} is no list", spec.items_field)
        _declared([spec.target_field, *spec.inputs.values(), *spec.extra_outputs], self.schema, "parent")
        _declared([x for x in (spec.errors_field, spec.count_field) if x], self.schema, "parent")
        _declared([spec.collect_field, *spec.inputs, *spec.extra_outputs.values()], spec.graph.schema, "child")
        if not parent[spec.target_field].is_list():
            raise CompileError("fan_out_field_not_list", f"{spec.target_field} is no list", spec.target_field)
        if spec.error_policy not in ("fail_fast", "collect") or spec.on_empty not in ("raise", "noop"):
            raise ValueError("error_policy: fail_fast or collect; on_empty: raise or noop")
        if spec.degraded is not None and spec.collect_field not in spec.degraded:
            raise CompileError("fan_out_degraded_update_missing_collect_field", f"degraded lacks {spec.collect_field}", name)
        if spec.item_field is not None and spec.item_field not in child:
            spec = replace(spec, item_field=None)  # an item that the child doesn't declare is dropped
        return self._add(Node(name, "fan_out", spec, tuple(middleware)))

    def add_branches(self, name: str, branches: Mapping[str, Branch], error_policy: str = "fail_fast", errors_field: str | None = None, middleware: Sequence = ()) -> GraphBuilder:
        if not branches:
            raise CompileError("parallel_branches_no_branches", "", name)
        for key, b in branches.items():
            if (b.graph is None) == (b.call is None) or (b.call is not None and (b.inputs or b.outputs)):
                raise CompileError("parallel_branches_invalid_branch_spec", f"{key}: a graph with inputs and outputs, or a call", key)
            if b.graph is not None:
                Explicit(b.inputs, b.outputs).check(self.schema, b.graph.schema)
        if errors_field is not None:
            _declared([errors_field], self.schema, "parent")
        return self._add(Node(name, "branches", Branches(dict(branches), error_policy, errors_field), tuple(middleware)))

    def add_edge(self, source: str, target: str) -> GraphBuilder:
        self._edges.append(Edge(source, target))
        return self

    def add_conditional_edge(self, source: str, choose: Callable[[State], Column], targets: Sequence[str] | None = None) -> GraphBuilder:
        self._edges.append(Edge(source, None, choose, tuple(targets) if targets is not None else None))
        return self

    def set_entry(self, name: str) -> GraphBuilder:
        self._entry = name
        return self

    def add_middleware(self, middleware) -> GraphBuilder:
        self._middleware.append(middleware)
        return self

    def with_state_migration(self, source: str, target: str, apply) -> GraphBuilder:
        self._migrations.add(Migration(source, target, apply))
        return self

    def with_state_migrations(self, steps: Sequence[Migration]) -> GraphBuilder:
        self._migrations.add_all(steps)
        return self

    def with_checkpoints(self, store) -> GraphBuilder:
        self._checkpoints = store
        return self

    def compile(self) -> CompiledGraph:
        """Checks in order: rules, projections, entry, endpoints, one edge a node, reach."""
        self.schema.check_reducers()
        for node in self._nodes.values():
            if node.kind == "subgraph":
                node.run.projection.check(self.schema, node.run.graph.schema)
        if self._entry is None:
            raise CompileError("no_declared_entry", "set_entry was not called")
        if self._entry not in self._nodes:
            raise CompileError("dangling_edge", f"entry {self._entry} is no node", self._entry)
        for e in self._edges:
            for end in (e.source, *([e.target] if e.target is not None else e.targets or ())):
                if end not in self._nodes and (end != END or end == e.source):
                    raise CompileError("dangling_edge", f"{e.source} to {e.target}: {end} is no node", end)
        edges: dict[str, Edge] = {}
        for e in self._edges:
            if e.source in edges:
                raise CompileError("multiple_outgoing_edges", "", e.source)
            edges[e.source] = e
        reached, todo = set(), [self._entry]
        while todo:
            n = todo.pop()
            if n in reached or n == END:
                continue
            reached.add(n)
            e = edges.get(n)
            if e is not None:
                todo += [e.target] if e.target is not None else list(self._nodes if e.targets is None else e.targets)
        for n in self._nodes:
            if n not in reached:
                raise CompileError("unreachable_node", "", n)
        for node in self._nodes.values():
            if node.kind == "subgraph":
                self._warn(node)
        return CompiledGraph(self.schema, self._entry, dict(self._nodes), edges, tuple(self._middleware), self._migrations, self._checkpoints)

    def _warn(self, node: Node) -> None:
        p, child = node.run.projection, node.run.graph.schema
        inward, outward = p.inward(self.schema, child), p.outward(self.schema, child)
        for parent, c in outward.items():
            if inward.get(c) == parent and self.schema.reducer(parent).round_trip_idempotent is False:
                warnings.warn(RoundTripWarning(f"{node.name}: {parent} goes in and out through {self.schema.reducer(parent).name}"), stacklevel=3)


@dataclass(frozen=True)
class CompiledGraph:
    schema: StateSchema
    entry: str
    nodes: Mapping[str, Node]
    edges: Mapping[str, Edge]
    middleware: tuple = ()
    migrations: Migrations = field(default_factory=Migrations)
    checkpoints: Any = None

    def targets(self, name: str) -> list[str]:
        """Nodes that may follow; a node without an edge ends the run."""
        e = self.edges.get(name)
        if e is None:
            return []
        ends = [e.target] if e.target is not None else list(self.nodes if e.targets is None else e.targets)
        return [t for t in ends if t != END]

    def order(self) -> list[str] | None:
        """Nodes in an order that follows all edges; None if the graph has a cycle."""
        out: list[str] = []
        state: dict[str, int] = {}

        def visit(n: str) -> bool:
            if state.get(n) == 1:
                return False
            if state.get(n) is None:
                state[n] = 1
                if not all(visit(t) for t in self.targets(n)):
                    return False
                state[n] = 2
                out.append(n)
            return True

        return out[::-1] if visit(self.entry) else None
