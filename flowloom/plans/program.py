"""Runs compiled graphs over DataFrames: one row per invocation.

An acyclic graph becomes one chain of projections: a node's update is guarded by the row's
place (`_at`), so conditional edges need no filter and no union, and Catalyst fuses the
chain. A subgraph is run the same way on prefixed columns. A fan-out evaluates its child
graph inside `transform` over the item array: instances keep their order and nothing is
shuffled. A cyclic graph is run in rounds over the rows that are still on their way, with a
limit on rounds; each round's table is written to the shared folder. A cycle inside a subgraph
or a branch is run in rounds on that child's columns; instances of a fan-out whose graph loops
become rows of their own, which leave the rounds one by one and are folded back in order.

Failures are data: `_error` is set, the row keeps the state from before the failing node,
and later nodes skip it. `strict` raises at the end instead.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..errors import ERROR_TYPE, FlowError, RunError
from ..functions.binding import let
from ..functions.reducers import merged
from ..sources.scratch import Scratch
from .graph import END, Branch, CompiledGraph, Explicit, Fail, Node, Write


def error(category: Any, message: Any, node: str, fan_out: str | None = None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_col(category).alias("category"), as_col(message).cast("string").alias("message"), F.lit(node).alias("node"), F.lit(fan_out).cast("string").alias("fan_out_category")
    )


def no_error() -> Column:
    return F.lit(None).cast(ERROR_TYPE)


def apply_partial(schema, state: Mapping[str, Column], partial: Mapping[str, Any], node: str) -> tuple[dict[str, Column], Column]:
    """The merged fields and the error (null: none) of a partial update; absent isn't null."""
    unknown = sorted(set(partial) - set(schema.fields) - {"!"})
    if unknown:
        raise FlowError("state_validation_error", f"{node} writes undeclared fields {unknown}", ",".join(unknown))
    fields, err = {}, no_error()
    fails = partial.get("!", ())
    for f in fails if isinstance(fails, (list, tuple)) else (fails,):
        err = F.coalesce(err, F.when(F.coalesce(f.when, F.lit(False)), error(f.category, f.message, node)))
    for name, update in partial.items():
        if name == "!":
            continue
        present = update.when if isinstance(update, Write) else None
        value = update.value if isinstance(update, Write) else update if isinstance(update, Column) else F.lit(update)
        value = value.cast(schema.fields[name].type)
        new, bad = merged(schema.reducer(name), state[name], value)
        if present is not None:
            present = F.coalesce(present, F.lit(False))
            new, bad = F.when(present, new).otherwise(state[name]), bad & present
        fields[name] = new
        err = F.coalesce(err, F.when(bad, error("reducer_error", name, node)))
    return fields, err


#: What a node takes: an expression to be evaluated once a row (None: nothing is used twice),
#: and how its value, or None, becomes the merged fields and the error.
Step = tuple[Column | None, Callable[[Column | None], tuple[dict[str, Column], Column]]]


def _branches(schema, state: Mapping[str, Column], node: Node, expressions: bool = True) -> Step:
    """Branches in declared order: present contributions are folded through the rules.

    Without `expressions` the child graphs' final states come from elsewhere.
    """
    spec = node.run
    collect = spec.error_policy == "collect"
    shown = {name: F.coalesce(b.when(state), F.lit(False)) if b.when is not None else F.lit(True) for name, b in spec.branches.items()}
    graphs = {
        name: inline(b.graph, child_state(b.graph, {c: state[s] for c, s in Explicit(b.inputs, b.outputs).inward(schema, b.graph.schema).items()}))
        for name, b in spec.branches.items() if b.call is None and expressions
    }
    once = let(F.struct(*(F.when(shown[name], g).alias(name) for name, g in graphs.items())), lambda x: x) if graphs else None

    def finish(value: Column | None) -> tuple[dict[str, Column], Column]:
        fields: dict[str, Column] = {}
        err, records, writers = no_error(), [], dict(state)
        for name, b in spec.branches.items():
            partial, failed = _branch_result(schema, state, b, name, value)
            partial = {k: v for k, v in partial.items() if k != "!"}
            updated_, bad = apply_partial(schema, writers, partial, node.name)
            failed = F.coalesce(failed, bad)
            present = shown[name]
            ok = present & failed.isNull()
            for f, new in updated_.items():
                writers[f] = fields[f] = F.when(ok, new).otherwise(writers[f])
            record = F.struct(
                F.lit(name).alias("branch_name"), failed["category"].alias("category"), failed["message"].alias("message"), failed["category"].alias("cause_type")
            )
            records.append(F.when(present & failed.isNotNull(), record))
            if not collect:
                blame = error("parallel_branches_branch_failed", F.concat_ws(": ", F.lit(name), failed["category"]), node.name)
                err = F.coalesce(err, F.when(present & failed.isNotNull(), blame))
        if collect and spec.errors_field:
            got = F.filter(F.array(*records), lambda r: r.isNotNull()).cast(schema.fields[spec.errors_field].type)
            more, bad = apply_partial(schema, writers, {spec.errors_field: got}, node.name)
            fields |= more
            err = F.coalesce(err, bad)
        return fields, err

    return once, finish


def _branch_result(schema, state, b: Branch, name: str, value: Column | None) -> tuple[Mapping[str, Any], Column]:
    if b.call is not None:
        partial = b.call(state)
        _, failed = apply_partial(schema, state, {"!": partial["!"]} if "!" in partial else {}, name)
        return partial, failed
    result = value[name]
    return {k: result[c] for k, c in Explicit(b.inputs, b.outputs).outward(schema, b.graph.schema).items()}, result["_error"]


def _asked(schema, state: Mapping[str, Column], spec) -> Column:
    """What the instances are made of: the items, or their number (it may be null or negative)."""
    if spec.items_field is not None:
        return F.coalesce(state[spec.items_field], F.array().cast(schema.fields[spec.items_field].type))
    return (spec.count(state) if callable(spec.count) else F.lit(spec.count)).cast("int")


def _items(spec, asked: Column) -> tuple[Column, Column]:
    """The instances' items, and their number."""
    if spec.items_field is not None:
        return asked, F.size(asked)
    return F.when(asked > 0, F.sequence(F.lit(0), asked - 1)).otherwise(F.array().cast("array<int>")), asked


def _outs(spec) -> dict[str, str]:
    return {spec.target_field: spec.collect_field, **spec.extra_outputs}


def _gathered(spec, n: Column, results: Column) -> Column:
    """What the parent takes from the instances' final states, in instance order."""

    def of(results: Column) -> Column:
        failed = F.filter(F.transform(results, lambda r, i: F.struct(i.cast("string").alias("fan_out_index"), r["_error"]["category"].alias("category"))), lambda r: r["category"].isNotNull())
        kept = F.filter(results, lambda r: r["_error"].isNull()) if spec.error_policy == "collect" else results
        return F.struct(n.alias("_n"), *(_gather(kept, c).alias(p) for p, c in _outs(spec).items()), failed.alias("_failed"), _first_error(results).alias("_first"))

    return let(results, of)


def _fan_out(schema, state: Mapping[str, Column], node: Node) -> Step:
    spec, child = node.run, node.run.graph
    if _refused(spec):
        return None, _finish_fan_out(schema, state, node)

    def instance(x: Column) -> Column:
        own = {c: state[p] for c, p in spec.inputs.items()}
        if spec.item_field is not None:
            own[spec.item_field] = x
        return inline(child, child_state(child, own))

    def all_of(asked: Column) -> Column:
        items, n = _items(spec, asked)
        return _gathered(spec, n, F.transform(items, instance))

    return let(_asked(schema, state, spec), all_of), _finish_fan_out(schema, state, node)


def _refused(spec) -> bool:
    return isinstance(spec.concurrency, int) and spec.concurrency <= 0


def _finish_fan_out(schema, state: Mapping[str, Column], node: Node) -> Callable[[Column | None], tuple[dict[str, Column], Column]]:
    spec = node.run
    outs = _outs(spec)

    def finish(got: Column | None) -> tuple[dict[str, Column], Column]:
        if got is None:
            return {}, error("node_exception", "concurrency", node.name, "fan_out_invalid_concurrency")
        err, n = no_error(), got["_n"]
        if spec.items_field is None:
            err = F.when(F.coalesce(n, F.lit(-1)) < 0, error("node_exception", "count", node.name, "fan_out_invalid_count"))
            n = F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))
        if callable(spec.concurrency):
            err = F.coalesce(err, F.when(spec.concurrency(state) <= 0, error("node_exception", "concurrency", node.name, "fan_out_invalid_concurrency")))
        if spec.on_empty == "raise":
            err = F.coalesce(err, F.when(n == 0, error("node_exception", "no instances", node.name, "fan_out_empty")))
        partial: dict[str, Any] = {p: got[p] for p in outs}
        if spec.error_policy == "collect":
            if spec.errors_field:
                partial[spec.errors_field] = got["_failed"]
        else:
            err = F.coalesce(err, F.when(got["_first"].isNotNull(), error("node_exception", F.concat_ws(": ", got["_first"]["category"], got["_first"]["message"]), node.name)))
        if spec.count_field:
            partial[spec.count_field] = n
        fields, bad = apply_partial(schema, state, partial, node.name)
        return fields, F.coalesce(err, bad)

    return finish


def _gather(results: Column, name: str) -> Column:
    return F.transform(results, lambda r: r[name])


def _first_error(results: Column) -> Column:
    return F.get(F.filter(F.transform(results, lambda r: r["_error"]), lambda e: e.isNotNull()), F.lit(0))


def child_state(graph: CompiledGraph, given: Mapping[str, Column]) -> Column:
    """A child's first state as a struct: what is given, else defaults."""
    return F.struct(*((given[n].cast(f.type) if n in given else f.initial()).alias(n) for n, f in graph.schema.fields.items()))


def updated(graph: CompiledGraph, node: Node, state: Mapping[str, Column]) -> Step:
    """What a node does to the state's columns."""
    if node.kind == "function":
        fn = node.run
        for m in (*node.middleware[::-1], *graph.middleware[::-1]):
            fn = m(fn)
        return None, lambda _: apply_partial(graph.schema, state, fn(state), node.name)
    if node.kind == "fan_out":
        return _fan_out(graph.schema, state, node)
    if node.kind == "branches":
        return _branches(graph.schema, state, node)
    p, child = node.run.projection, node.run.graph

    def finish(result: Column) -> tuple[dict[str, Column], Column]:
        fields, bad = apply_partial(graph.schema, state, {k: result[c] for k, c in p.outward(graph.schema, child.schema).items()}, node.name)
        return fields, F.coalesce(result["_error"], bad)

    return inline(child, child_state(child, {c: state[s] for c, s in p.inward(graph.schema, child.schema).items()})), finish


def routed(graph: CompiledGraph, name: str, state: Mapping[str, Column]) -> tuple[Column, Column]:
    """Where a row goes after a node, and the routing error (null: none)."""
    e = graph.edges.get(name)
    if e is None:
        return F.lit(END), no_error()
    if e.target is not None:
        return F.lit(e.target), no_error()
    to = e.choose(state)
    known = to.isin(*(e.targets or (*graph.nodes, END)))
    return to, F.when(~F.coalesce(known, F.lit(False)), error("routing_error", F.concat(F.lit("no node "), F.coalesce(to, F.lit("null"))), name))


def inline(graph: CompiledGraph, state: Column) -> Column:
    """The final state of an acyclic graph as a struct of its fields and `_error`."""
    order = graph.order()
    if order is None:
        raise FlowError("node_exception", "a cyclic graph can't run inside an expression")
    names = list(graph.schema.fields)
    always = len(order) == 1

    def start(s: Column) -> Column:
        return F.struct(*(s[n].alias(n) for n in names), F.lit(graph.entry).alias("_at"), no_error().alias("_error"))

    def step(name: str):
        def run(s: Column) -> Column:
            here = F.lit(True) if always else (s["_at"] == name) & s["_error"].isNull()
            once, finish = updated(graph, graph.nodes[name], {n: s[n] for n in names})
            if once is None:
                return after(s, here, *finish(None))
            return let(once if always else F.when(here, once), lambda value: after(s, here, *finish(value)))

        def after(s: Column, here: Column, fields: dict[str, Column], err: Column) -> Column:

            def place(v: Column) -> Column:
                to, bad = routed(graph, name, {n: v[n] for n in names})
                ok = here & v["_error"].isNull()
                return F.struct(*(v[n].alias(n) for n in names), F.when(ok, to).otherwise(v["_at"]).alias("_at"), F.coalesce(v["_error"], F.when(ok, bad)).alias("_error"))

            def merge(e: Column) -> Column:
                ok = here & e.isNull()
                return F.struct(
                    *((F.when(ok, fields[n]).otherwise(s[n]) if n in fields else s[n]).alias(n) for n in names), s["_at"].alias("_at"),
                    F.coalesce(s["_error"], F.when(here, e)).alias("_error"),
                )

            return let(let(err, merge), place)

        return run

    out = let(state, start)
    for name in order:
        out = let(out, step(name))
    return out


class How(NamedTuple):
    """How a frame is run: whether it keeps paths, what saves completed nodes, how many rounds a cycle may take."""

    trace: bool = False
    saver: Any = None
    max_rounds: int = 100


def graphs_inside(node: Node) -> list[CompiledGraph]:
    if node.kind == "branches":
        return [b.graph for b in node.run.branches.values() if b.graph is not None]
    return [node.run.graph] if node.kind in ("subgraph", "fan_out") else []


def loops(graph: CompiledGraph) -> bool:
    """Whether the graph or one inside it has a cycle: then its rounds are jobs, not an expression."""
    return graph.order() is None or any(loops(g) for node in graph.nodes.values() for g in graphs_inside(node))


def _frame_step(graph: CompiledGraph, df: DataFrame, name: str, col: Mapping[str, str], pre: str, how: How) -> DataFrame:
    node = graph.nodes[name]
    at, err = F.col(pre + "_at"), F.col(pre + "_error")
    here = (at == name) & err.isNull()
    state = {n: F.col(c) for n, c in col.items()}
    if node.kind == "subgraph":
        df, fields, failed, extra = _frame_subgraph(graph, df, node, col, pre, here, how)
    else:
        path, extra = [*pre.strip("_").split("__"), name] if pre else [name], [pre + "_once"]
        if node.kind == "fan_out" and not _refused(node.run) and (loops(node.run.graph) or (node.run.flushes and how.saver is not None)):
            df = _frame_fan_out(graph, df, node, state, pre, here, path, how)
            finish = _finish_fan_out(graph.schema, state, node)
        elif node.kind == "branches" and any(map(loops, graphs_inside(node))):
            df, more = _frame_branches(graph, df, node, state, pre, here, how)
            extra, (_, finish) = [*extra, *more], _branches(graph.schema, state, node, expressions=False)
        else:
            once, finish = updated(graph, node, state)
            if once is None:
                extra = []
            else:  # used more than once below, so the optimizer keeps it a column
                df = df.withColumn(pre + "_once", F.when(here, once))
        fields, failed = finish(F.col(pre + "_once") if extra else None)
    df = df.withColumn(pre + "_new", F.when(here, failed))
    ok = here & F.col(pre + "_new").isNull()
    made = {col[n]: F.when(ok, new).otherwise(F.col(col[n])) for n, new in fields.items()}
    made[pre + "_here"] = here
    if how.trace:
        made["_path"] = F.when(here, F.concat("_path", F.array(F.lit(name)))).otherwise(F.col("_path"))
    df = df.withColumns(made)
    to, bad = routed(graph, name, state)
    ok = F.col(pre + "_here") & F.col(pre + "_new").isNull()
    df = df.withColumns(
        {
            pre + "_at": F.when(ok, to).otherwise(at),
            pre + "_error": F.coalesce(err, F.col(pre + "_new"), F.when(ok, bad)),
            "_step": F.col("_step") + F.when(F.col(pre + "_here"), 1).otherwise(0) if node.kind != "subgraph" else F.col("_step"),
        }
    )
    if how.saver is not None:
        df = how.saver(df, [*pre.strip("_").split("__"), name] if pre else [name], ok & F.col(pre + "_error").isNull(), [pre + "_new", pre + "_here", *extra])
    return df.drop(pre + "_new", pre + "_here", *extra)


def _frame_child(child: CompiledGraph, df: DataFrame, own: str, given: Mapping[str, Column], here: Column, how: How) -> tuple[DataFrame, dict[str, str], list[str]]:
    """Runs a child graph on columns of its own beside the parent's: no lambda, full codegen.

    Rows where `here` doesn't hold are at its end from the start. Returns the child's columns
    by field, and all columns that it has added.
    """
    names = {n: f"{own}__{n}" for n in child.schema.fields}
    first = {names[n]: (given[n].cast(f.type) if n in given else f.initial()) for n, f in child.schema.fields.items()}
    begin = F.lit(child.entry)
    if WAS + own + "_at" in df.columns:  # a resumed row goes on inside the child, once
        inside = F.col(WAS + own + "_at")
        first = {c: F.when(inside.isNotNull(), F.col(WAS + c)).otherwise(v) for c, v in first.items()}
        begin = F.coalesce(inside, begin)
        first[WAS + own + "_at"] = F.when(here, F.lit(None).cast("string")).otherwise(inside)
    df = df.withColumns({**first, own + "_at": F.when(here, begin).otherwise(F.lit(END)), own + "_error": no_error()})
    order = child.order()
    if order is None:
        df = _rounds(child, df, names, own, how)
    else:
        for n in order:
            df = _frame_step(child, df, n, names, own, how)
    return df, names, [*names.values(), own + "_at", own + "_error"]


def _frame_subgraph(graph, df, node: Node, col, pre, here, how: How):
    p, child = node.run.projection, node.run.graph
    own = f"{pre}__{node.name}"
    df, names, extra = _frame_child(child, df, own, {c: F.col(col[s]) for c, s in p.inward(graph.schema, child.schema).items()}, here, how)
    outward = p.outward(graph.schema, child.schema)
    fields, bad = apply_partial(graph.schema, {n: F.col(c) for n, c in col.items()}, {k: F.col(names[c]) for k, c in outward.items()}, node.name)
    return df, fields, F.coalesce(F.col(own + "_error"), bad), extra


def _frame_branches(graph, df, node: Node, state, pre, here, how: How) -> tuple[DataFrame, list[str]]:
    """The branches' child graphs on columns of their own; their final states in `_once`."""
    extra, values = [], []
    for name, b in node.run.branches.items():
        if b.call is not None:
            continue
        own, shown = f"{pre}__{node.name}__{name}", here
        if b.when is not None:
            shown = here & F.coalesce(b.when(state), F.lit(False))
        inward = Explicit(b.inputs, b.outputs).inward(graph.schema, b.graph.schema)
        df, names, more = _frame_child(b.graph, df, own, {c: state[s] for c, s in inward.items()}, shown, how._replace(saver=None))
        values.append(F.when(shown, F.struct(*(F.col(c).alias(n) for n, c in names.items()), F.col(own + "_error").alias("_error"))).alias(name))
        extra += more
    return df.withColumn(pre + "_once", F.struct(*values)), extra


def _frame_fan_out(graph, df, node: Node, state, pre, here, path: list[str], how: How) -> DataFrame:
    """The instances as rows of their own, run by themselves and folded back in order into `_once`.

    A row is named by a number that is written down first, an instance by that and its place;
    both go with it through all rounds of the child graph, and of fan-outs inside it. With a
    checkpoint store the results are saved as they come (FanOut.flushes).
    """
    spec, child = node.run, node.run.graph
    key = f"_row{sum(c.startswith('_row') for c in df.columns)}"
    progress = how.saver.progress(path, child, spec) if how.saver is not None and spec.flushes else None
    if progress is not None:
        df = progress.begun(df, here)
    asked, kept = _asked(graph.schema, state, spec), {key: F.monotonically_increasing_id()}
    if spec.items_field is None:  # a number may be another when it is asked for again
        kept[key + "_of"] = F.when(here, asked)
    table = Scratch(df.sparkSession, "instances", "zstd").save(df.withColumns(kept))
    items, n = _items(spec, F.when(here, asked) if spec.items_field is not None else F.col(key + "_of"))
    given = [state[p].alias("_in_" + c) for c, p in spec.inputs.items()]
    own = {c: F.col("_in_" + c) for c in spec.inputs}
    if spec.item_field is not None:
        own[spec.item_field] = F.col("_item")
    fields = list(child.schema.fields)

    def results(rows: DataFrame, places: Column | None = None, *more: str) -> DataFrame:
        """The instances of rows (those at `places` only) with their final states."""
        if places is None:
            planned = rows.select(key, *more, n.alias("_n"), *given, F.posexplode(items).alias("_pos", "_item"))
        else:
            one = F.explode(F.transform(places, lambda p: F.struct(p.alias("_pos"), F.get(items, p).alias("_item"))))
            planned = rows.select(key, *more, n.alias("_n"), *given, one.alias("_one")).select("*", "_one.*")
        kept = [key, "_pos", *more, *(["_n"] if more else [])]
        done = run(child, planned.select(*kept, child_state(child, own).alias("_first")).select(*kept, "_first.*"), max_rounds=how.max_rounds)
        return done.select(*kept, F.struct(*fields, "_error").alias("_result"))

    def folded(done: DataFrame) -> DataFrame:
        return done.groupBy(F.col(key).alias("_of")).agg(F.collect_list(F.struct("_pos", "_result")).alias("_all"))

    if progress is None:
        back = table.join(folded(results(table.where(here))), F.col(key) == F.col("_of"), "left").drop("_of")
    else:
        back = progress.run(table, key, here, n, results, folded)
    kind = back.schema["_all"].dataType.elementType["_result"].dataType
    every = F.transform(F.array_sort("_all", lambda a, b: a["_pos"] - b["_pos"]), lambda x: x["_result"])
    every = F.coalesce(every, F.array().cast(ArrayType(kind)))
    return back.withColumn(pre + "_once", F.when(here, _gathered(spec, n, every))).drop("_all", *kept)


#: The column of a saved run: who it is, whose run it goes on with, what it has completed.
RUN = "_run"

#: Prefix of the columns that hold where a resumed row stood inside subgraphs.
WAS = "_was"


def inner_columns(graph: CompiledGraph, pre: str = "") -> dict[str, str]:
    """The columns that rows have while they are inside subgraphs, at any depth, with types."""
    out: dict[str, str] = {}
    for node in graph.nodes.values():
        if node.kind == "subgraph":
            own, child = f"{pre}__{node.name}", node.run.graph
            out |= {own + "_at": "string", **{f"{own}__{n}": f.type for n, f in child.schema.fields.items()}, **inner_columns(child, own)}
    return out


def run(graph: CompiledGraph, df: DataFrame, strict: bool = False, max_rounds: int = 100, trace: bool = False, start: Column | None = None, invocation: str | None = None, correlation: str | None = None) -> DataFrame:
    """df with its state columns after the run, and `_at`, `_error`, `_step` (and `_path`).

    df must have the schema's columns (StateSchema.initial_state); other columns are kept.
    `start` is where each row begins, the entry by default: a resumed row begins later. With
    a checkpoint store on the graph and `invocation`, the column that names rows, every
    completed node is saved, those inside subgraphs included (checkpoints.resume goes on
    from there); `correlation` names what a row belongs to, itself by default.
    """
    saver = None
    if graph.checkpoints is not None and (invocation is not None or RUN in df.columns):
        df = graph.checkpoints.begun(df, invocation, correlation)
        saver = graph.checkpoints.saver(graph, df.sparkSession)
    df = df.withColumns({"_at": start if start is not None else F.lit(graph.entry), "_error": no_error(), "_step": F.lit(0).cast("long")})
    if trace:
        df = df.withColumn("_path", F.array().cast("array<string>"))
    col, how = {n: n for n in graph.schema.fields}, How(trace, saver, max_rounds)
    order = graph.order()
    if order is not None:
        for name in order:
            df = _frame_step(graph, df, name, col, "", how)
    else:
        df = _rounds(graph, df, col, "", how)
    df = df.drop(RUN, *(c for c in df.columns if c.startswith(WAS)))
    if strict:
        failed = df.where(F.col("_error").isNotNull()).select("_error").first()
        if failed is not None:
            e = failed["_error"]
            raise RunError(e["category"], e["message"] or "", e["node"])
    return df


def _rounds(graph: CompiledGraph, df: DataFrame, col: Mapping[str, str], pre: str, how: How) -> DataFrame:
    """Rows that are done leave the loop at once; only those on their way are worked on.

    Of small graphs several rounds make one job. Each job's table is written to the shared
    folder, with the number of rows that are still moving.
    """
    scratch = Scratch(df.sparkSession, "rounds")
    moving = (F.col(pre + "_at") != END) & F.col(pre + "_error").isNull()
    jobs_inside = how.saver is not None or any(loops(g) for node in graph.nodes.values() for g in graphs_inside(node))
    at_once = 1 if jobs_inside else max(1, STEPS_A_JOB // len(graph.nodes))
    done: list[DataFrame] = []
    todo, left = df, how.max_rounds
    while left > 0:
        for _ in range(min(at_once, left)):
            for name in graph.nodes:
                todo = _frame_step(graph, todo, name, col, pre, how)
        left -= at_once
        table, n = scratch.counted(todo, moving)
        done.append(table.where(~moving))
        todo = table.where(moving)
        if not n:
            break
    else:
        raise RunError("node_exception", f"rows are still moving after {how.max_rounds} rounds")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


#: Steps of a cyclic graph that are planned as one job.
STEPS_A_JOB = 12


# ------------------------------------------------------------------ middleware


def retry(max_attempts: int = 3, transient: tuple[str, ...] | None = None):
    """A node sees its attempt as state["_attempt"]; the first that doesn't fail counts.

    An attempt is repeated only while its error's category is transient.
    """
    from ..errors import TRANSIENT_CATEGORIES

    if max_attempts < 1:
        raise ValueError("max_attempts must be 1 or more")
    again = transient or TRANSIENT_CATEGORIES

    def wrap(fn):
        def attempts(state):
            tries = [fn({**state, "_attempt": F.lit(k)}) for k in range(max_attempts)]
            fails = [_fail_of(t) for t in tries]
            names = list(dict.fromkeys(n for t in tries for n in t if n != "!"))
            use = F.lit(max_attempts - 1)  # the attempt that counts
            for k in range(max_attempts - 2, -1, -1):
                use = F.when(fails[k][0] & F.coalesce(fails[k][1].isin(*again), F.lit(False)), use).otherwise(F.lit(k))
            out: dict[str, Any] = {}
            for n in names:
                value, there = F.lit(None), F.lit(False)
                for k, t in enumerate(tries):
                    if n in t:
                        v, w = (t[n].value, t[n].when) if isinstance(t[n], Write) else (t[n] if isinstance(t[n], Column) else F.lit(t[n]), F.lit(True))
                        value, there = F.when(use == k, v).otherwise(value), F.when(use == k, w).otherwise(there)
                out[n] = Write(value, there)
            failed, category, message = F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string")
            for k, (f, c, m) in enumerate(fails):
                failed, category, message = (F.when(use == k, x).otherwise(y) for x, y in ((f, failed), (c, category), (m, message)))
            return {**out, "!": Fail(failed, message, category)}

        return attempts

    return wrap


def _fail_of(partial: Mapping[str, Any]) -> tuple[Column, Column, Column]:
    """Whether a partial fails, with category and message of its first failure."""
    fails = partial.get("!", ())
    failed, category, message = F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string")
    for f in reversed(fails if isinstance(fails, (list, tuple)) else (fails,)):
        when = F.coalesce(f.when, F.lit(False))
        failed = when | failed
        category = F.when(when, f.category if isinstance(f.category, Column) else F.lit(f.category)).otherwise(category)
        message = F.when(when, f.message if isinstance(f.message, Column) else F.lit(f.message)).otherwise(message)
    return failed, category, message


def isolate(degraded, catch: tuple[str, ...] | None = None, predicate=None):
    """A failing node gives `degraded` (a mapping, or a function of state) instead.

    Only categories in `catch`, and rows for which predicate(state) holds, are isolated.
    """

    def wrap(fn):
        def guarded(state):
            partial = fn(state)
            failed, category, message = _fail_of(partial)
            caught = failed
            if catch is not None:
                caught = caught & F.coalesce(category.isin(*catch), F.lit(False))
            if predicate is not None:
                caught = caught & F.coalesce(predicate(state), F.lit(False))
            instead = degraded(state) if callable(degraded) else degraded
            out: dict[str, Any] = {}
            for n in dict.fromkeys([*(k for k in partial if k != "!"), *instead]):
                p = partial.get(n)
                value, there = (p.value, p.when) if isinstance(p, Write) else (p if isinstance(p, Column) else F.lit(p), F.lit(n in partial))
                d = instead.get(n)
                d = d if isinstance(d, Column) else F.lit(d)
                out[n] = Write(F.when(caught, d).otherwise(value), F.when(caught, F.lit(n in instead)).otherwise(there))
            return {**out, "!": Fail(failed & ~caught, message, category)}

        return guarded

    return wrap


def short_circuit(when, update: Mapping[str, Any]):
    """Rows for which when(state) holds get `update` and skip the node."""

    def wrap(fn):
        def guarded(state):
            skip, partial = F.coalesce(when(state), F.lit(False)), fn(state)
            failed, category, message = _fail_of(partial)
            out: dict[str, Any] = {}
            for n in dict.fromkeys([*(k for k in partial if k != "!"), *update]):
                p = partial.get(n)
                value, there = (p.value, p.when) if isinstance(p, Write) else (p if isinstance(p, Column) else F.lit(p), F.lit(n in partial))
                u = update.get(n)
                out[n] = Write(F.when(skip, u if isinstance(u, Column) else F.lit(u)).otherwise(value), F.when(skip, F.lit(n in update)).otherwise(there))
            return {**out, "!": Fail(failed & ~skip, message, category)}

        return guarded

    return wrap
