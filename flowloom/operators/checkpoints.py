"""Checkpoints as append-only tables: saves of runs, lineage, latest record, resume, migration.

A run saves every node that a row has completed. What it saves is told apart by invocation
and sequence number: the number starts above the largest that the table holds of the
invocation, or of the record that a resumed row comes from, so records of a restarted driver
or of another store object over the same folder are later ones. A resumed row is a new
invocation of the same root and correlation id, and saves as such.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import CheckpointError
from ..functions.binding import let
from ..plans.graph import CompiledGraph, FanOut, Migrations
from ..plans.program import RUN, WAS, error, inner_columns, run

#: The columns of a checkpoint table; `state` is a struct or JSON.
KEY, SEQUENCE = "invocation_id", "seq"
#: What a run's records hold. completed_positions: path and step of every node that the row
#: has completed so far, in this run and in those that it goes on with.
POSITIONS = "array<struct<path: string, step: bigint>>"
RECORD = f"invocation_id string, root_id string, resumed_from string, correlation_id string, seq bigint, node string, schema_version string, last_saved_at timestamp, completed_positions {POSITIONS}, state string"
#: A finished instance of a fan-out. visit: how often the row had completed the node before.
PROGRESS = "root_id string, invocation_id string, path string, visit bigint, fan_out_index int, instance_count int, state string, result string, result_is_error boolean"
#: Records repeat much of each other's JSON and are read once or twice.
CODEC = "zstd"
#: How timestamps are kept in JSON.
STAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class CheckpointStore:
    """A folder to which every save appends; readers see the last save of each key.

    Below it lie `records` (saved and deleted by hand), `frames` (a table for each save of a
    run: records, and the frame that the run goes on with, written together) and `progress`
    (finished instances of fan-outs). Appending keeps saves independent: a lost executor
    repeats its own files only, and a save that is written twice has the same key and number.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = KEY, sequence: str = SEQUENCE):
        self.spark, self.path, self.key, self.sequence = spark, path.rstrip("/"), key, sequence

    # -------------------------------------------------------------- records

    def save(self, records: DataFrame) -> None:
        records.withColumn("_deleted", F.lit(False)).write.mode("append").parquet(f"{self.path}/records")

    def _read(self, folder: str, schema: str | None = None) -> DataFrame | None:
        """A table below the store's folder; None if nothing has been written to it."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return None
        reader = self.spark.read.option("recursiveFileLookup", "true").option("mergeSchema", str(schema is None).lower())
        return (reader.schema(schema) if schema else reader).parquet(f"{self.path}/{folder}")

    def _raw(self) -> DataFrame:
        own, frames = self._read("records"), self._read("frames", f"{RECORD}, _saved boolean")
        if frames is not None:
            frames = frames.where("_saved").drop("_saved").withColumn("_deleted", F.lit(False))
        if own is None and frames is None:
            return self.spark.createDataFrame([], f"{RECORD}, _deleted boolean")
        return own.unionByName(frames, allowMissingColumns=True) if own is not None and frames is not None else frames if own is None else own

    def all(self) -> DataFrame:
        return self._raw().where("not _deleted").drop("_deleted")

    def latest(self) -> DataFrame:
        return self._last(self._raw())

    def _last(self, raw: DataFrame) -> DataFrame:
        return latest(raw, self.key, self.sequence).where("not _deleted").drop("_deleted")

    def load(self, invocation: str) -> DataFrame:
        """The record's row, none if there is none; the filter reaches the scan."""
        return self._last(self._raw().where(F.col(self.key) == invocation))

    def heads(self) -> DataFrame:
        """The last record of each root, whichever of its invocations saved it."""
        return latest(self.latest(), "root_id", self.sequence)

    def list(self, correlation: str | None = None) -> DataFrame:
        return listing(self.latest(), correlation)

    def delete(self, invocation: str) -> None:
        """Appends a tombstone; deleting what isn't there is no error. Later saves count again."""
        raw = self._raw()
        last = raw.where(F.col(self.key) == invocation).agg(F.max(self.sequence)).first()[0] or 0
        kind = {f.name: f.dataType for f in raw.schema}
        row = self.spark.range(1).select(
            F.lit(invocation).cast(kind[self.key]).alias(self.key), F.lit(last + 1).cast(kind[self.sequence]).alias(self.sequence), F.lit(True).alias("_deleted")
        )
        row.write.mode("append").parquet(f"{self.path}/records")

    def compact(self) -> None:
        """The last record of each invocation replaces all that was saved; deleted ones go.

        The new table is sorted by key over its files, and has bloom filters on the key, the
        root and the correlation id: a point load reads the one row group that may hold it.
        It is complete before anything is removed; until then a reader that sees
        both finds the same records twice, under the same numbers.
        """
        kept = f"compact-{uuid.uuid4().hex[:12]}"
        last = self.latest().withColumn("_deleted", F.lit(False))
        writer = last.repartitionByRange(self.key).sortWithinPartitions(self.key).write
        for c in {self.key, "root_id", "correlation_id"} & set(last.columns):
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.path}/{kept}")
        jvm = self.spark.sparkContext._jvm
        path = lambda x: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}")
        fs = path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        old = [path("frames"), *(s.getPath() for s in (fs.listStatus(path("records")) if fs.exists(path("records")) else []))]
        fs.mkdirs(path("records"))
        if not fs.rename(path(kept), path(f"records/{kept}")):
            raise CheckpointError("checkpoint_save_failed", f"{kept} can't be moved")
        for p in old:
            fs.delete(p, True)

    # -------------------------------------------------------------- runs

    def begun(self, df: DataFrame, invocation: str | None, correlation: str | None = None) -> DataFrame:
        """df with who each row is (`_run`); its numbers go on above those the table has of it."""
        if RUN in df.columns:  # resumed rows
            return df
        name = F.col(invocation).cast("string")
        other = F.col(correlation).cast("string") if correlation is not None else name
        df = df.withColumn(RUN, _who(name, name, F.lit(None).cast("string"), other, F.lit(0).cast("long"), F.array().cast(POSITIONS)))
        return self.above(df, name)

    def above(self, df: DataFrame, name: Column, run_id: str | None = None) -> DataFrame:
        """df with the base of `_run` at the largest number saved of the row's invocation: name itself, or `<name>~<run_id>`.

        Both are found by name, which the rows of a resumed run are dealt by already.
        """
        saved = self._raw() if self._read("frames", RECORD) is not None or self._read("records") is not None else None
        if saved is None or self.key not in saved.columns:
            return df
        own, tail = F.col(self.key).cast("string"), f"~{run_id}"
        of = F.struct(own.alias("name"), F.lit(False).alias("resumed"))
        resumed = F.struct(F.substring(own, F.lit(1), F.length(own) - len(tail)).alias("name"), F.lit(True).alias("resumed"))
        each = F.array(of) if run_id is None else F.when(own.endswith(tail), F.array(of, resumed)).otherwise(F.array(of))
        top = saved.select(F.explode(each).alias("_e"), F.col(self.sequence).cast("long").alias("_n")).groupBy(F.col("_e")["name"].alias("_k"))
        top = top.agg(F.max(F.when(~F.col("_e")["resumed"], F.col("_n"))).alias("_own"), F.max(F.when(F.col("_e")["resumed"], F.col("_n"))).alias("_resumed"))
        last = F.when(F.col(RUN)["invocation"] == F.col(RUN)["root"], F.col("_own")).otherwise(F.col("_resumed"))
        both = df.join(top, name == F.col("_k"), "left")
        return both.withColumn(RUN, F.col(RUN).withField("base", F.greatest(F.col(RUN)["base"], F.coalesce(last, F.lit(0))))).drop("_k", "_own", "_resumed")

    def saver(self, graph: CompiledGraph, spark: SparkSession) -> Saver:
        return Saver(self, graph, spark)

    def progress(self) -> DataFrame:
        """The finished instances of fan-outs, as they were flushed."""
        got = self._read("progress", PROGRESS)
        return self.spark.createDataFrame([], PROGRESS) if got is None else got

    def has_progress(self) -> bool:
        return self._read("progress", PROGRESS) is not None

    def save_progress(self, instances: DataFrame) -> None:
        instances.write.mode("append").option("compression", CODEC).parquet(f"{self.path}/progress")


def _who(invocation: Column, root: Column, before: Column, correlation: Column, base: Column, done: Column) -> Column:
    return F.struct(
        invocation.alias("invocation"), root.alias("root"), before.alias("resumed_from"), correlation.alias("correlation"), base.alias("base"), done.alias("done")
    )


class Saver:
    """What a run calls after each node: saves the rows that have completed it.

    A record has the next place (`_at`), the path of the node, and the state as JSON, with
    that of the subgraphs that the row is in. It is written in one table with the frame that
    the run goes on with, so saving neither writes twice nor runs earlier nodes again.
    """

    def __init__(self, store: CheckpointStore, graph: CompiledGraph, spark: SparkSession):
        self.store, self.graph, self.spark = store, graph, spark
        self.inner, self.run, self.n = inner_columns(graph), uuid.uuid4().hex[:12], 0

    def __call__(self, frame: DataFrame, path: list[str], completed: Column, drop: list[str]) -> DataFrame:
        self.n += 1
        where, who = "/".join(path), F.col(RUN)
        mark = F.coalesce(completed, F.lit(False))
        step = F.array(F.struct(F.lit(where).alias("path"), F.col("_step").alias("step")))
        frame = frame.withColumns({"_saved": mark, RUN: F.when(mark, who.withField("done", F.concat(who["done"], step))).otherwise(who)})
        # a row stands in the subgraphs on the path; what other columns hold is over
        own = [c for c in self.inner if c in frame.columns and c not in drop and any(c.startswith("__" + "__".join(path[:k])) for k in range(1, len(path)))]
        whole = F.to_json(F.struct("_at", "_step", *self.graph.schema.fields, *own), STAMPS)
        # inside a subgraph the outer step doesn't move: the run's saves are numbered themselves
        record = {
            "invocation_id": who["invocation"], "root_id": who["root"], "resumed_from": who["resumed_from"], "correlation_id": who["correlation"], "seq": who["base"] + self.n,
            "node": F.lit(where), "schema_version": F.lit(self.graph.schema.version), "last_saved_at": F.current_timestamp(), "completed_positions": who["done"], "state": whole,
        }
        kept = [c for c in frame.columns if c != "_saved" and (c not in drop or c.endswith("_here"))]
        out = frame.select(*(F.when(F.col("_saved"), c).alias(n) for n, c in record.items()), "_saved", F.struct(*kept).alias("_frame"))
        folder = f"{self.store.path}/frames/{self.run}-{self.n:05d}"
        out.write.option("compression", CODEC).parquet(folder)
        return self.spark.read.schema(out.select("_frame").schema).parquet(folder).select("_frame.*")

    def progress(self, path: list[str], child: CompiledGraph, spec: FanOut) -> FanOutProgress:
        return FanOutProgress(self.store, "/".join(path), child, spec)


class FanOutProgress:
    """Runs a fan-out's instances in `flushes` jobs and saves each job's finished ones.

    Those that an earlier run of the row's root has saved at this place (path, visit and
    index) aren't run again. A row whose number of instances isn't the saved one fails
    with checkpoint_record_invalid. Under fail_fast only instances without error count
    as finished. What is saved is brought to the rows, all instances of a row at once: before
    the run their places, after it their results. No instance is shuffled on its way there.
    """

    def __init__(self, store: CheckpointStore, where: str, child: CompiledGraph, spec: FanOut):
        self.store, self.where, self.child, self.spec = store, where, child, spec

    def _names(self) -> tuple[Column, Column]:
        """A row's root, and how often it had completed the node before."""
        who = F.col(RUN)
        return who["root"], F.size(F.filter(who["done"], lambda d: d["path"] == self.where)).cast("long")

    def _with_saved(self, df: DataFrame, here: Column, name: str, each: Column) -> DataFrame:
        """df with what is saved of each row, as an array."""
        root, visit = self._names()
        mine = self.store.progress().where(F.col("path") == self.where).select(F.col("root_id").alias("_root"), F.col("visit").alias("_visit"), each.alias("_each"))
        mine = mine.repartition("_root", "_visit").groupBy("_root", "_visit").agg(F.collect_list("_each").alias(name))
        return df.join(mine, (F.when(here, root) == F.col("_root")) & (visit == F.col("_visit")), "left").drop("_root", "_visit")

    def begun(self, df: DataFrame, here: Column) -> DataFrame:
        """df with the places of its rows' finished instances."""
        if self.store.has_progress():
            return self._with_saved(df, here, "_done", F.col("fan_out_index"))
        return df.withColumn("_done", F.lit(None).cast("array<int>"))

    def run(self, table: DataFrame, key: str, here: Column, n: Column, results, folded) -> DataFrame:
        """table with the instances' places and results (`_all`). results: runs the instances at given places of rows; folded: those by row."""
        flushes, fail_fast = self.spec.flushes, self.spec.error_policy == "fail_fast"
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        todo = F.when(F.col("_done").isNull(), places).otherwise(F.array_except(places, "_done"))
        (root, visit), lost = self._names(), 0
        named = table.where(here).withColumns({"_name": root, "_times": visit, "_invocation": F.col(RUN)["invocation"]})
        for k in range(flushes):
            done = results(named, F.filter(todo, lambda p: F.pmod(p, F.lit(flushes)) == k), "_name", "_times", "_invocation")  # noqa: B023
            failed, seen = F.col("_result")["_error"].isNotNull(), Observation()
            rows = done.observe(seen, F.count_if(failed).alias("n")).where(~failed) if fail_fast else done
            self.store.save_progress(rows.select(
                F.col("_name").alias("root_id"), F.col("_invocation").alias("invocation_id"), F.lit(self.where).alias("path"), F.col("_times").alias("visit"), F.col("_pos").alias("fan_out_index"),
                F.col("_n").alias("instance_count"), F.lit("completed").alias("state"), F.to_json("_result", STAMPS).alias("result"), failed.alias("result_is_error"),
            ))
            lost += seen.get["n"] if fail_fast else 0
        kind = ", ".join(f"`{n}`: {f.type}" for n, f in self.child.schema.fields.items())
        kind = f"struct<{kind}, _error: struct<category: string, message: string, node: string, fan_out_category: string>>"
        wrong = lambda count: error("checkpoint_record_invalid", F.concat(F.lit("saved instances "), count, F.lit(", now "), n), self.where)

        def result(x: Column) -> Column:
            value = F.from_json(x["result"], kind, STAMPS)
            return F.struct(x["fan_out_index"].alias("_pos"), F.when(x["instance_count"] != n, value.withField("_error", wrong(x["instance_count"]))).otherwise(value).alias("_result"))

        # all that is finished now; of one place that was saved twice the last
        back = self._with_saved(table.drop("_done"), here, "_saved_all", F.struct("fan_out_index", "instance_count", "result"))
        last = let(F.array_sort("_saved_all"), lambda s: F.filter(s, lambda x, i: (x["fan_out_index"] < n) & F.coalesce(F.get(s, i + 1)["fan_out_index"] != x["fan_out_index"], F.lit(True))))
        back = back.withColumn("_all", F.transform(last, result)).drop("_saved_all")
        if lost:  # and the instances that failed: those run once more, as an expression would
            have = F.coalesce(F.transform("_all", lambda x: x["_pos"]), F.array().cast("array<int>"))
            again = folded(results(back.where(here), F.array_except(places, have))).withColumnRenamed("_all", "_more")
            back = back.join(again, F.col(key) == F.col("_of"), "left").drop("_of")
            back = back.withColumn("_all", F.when(F.col("_all").isNull(), F.col("_more")).when(F.col("_more").isNull(), F.col("_all")).otherwise(F.concat("_all", "_more"))).drop("_more")
        return back


def resume(graph: CompiledGraph, df: DataFrame, records: DataFrame, rows: str, key: str = KEY, run_id: str | None = None, **options) -> DataFrame:
    """Runs the rows of df: those with a record from where it was saved, the others whole.

    df has the schema's columns; records are the latest of each invocation, or of each root
    (CheckpointStore.heads), which `rows`, the column that names df's rows, is held against.
    State of subgraphs that a row was in is taken up again, so only nodes after the saved one
    run. With a checkpoint store on the graph the run saves: a row with a record as
    invocation `<root>~<run_id>`, with the record's correlation id and with numbers above
    it, the others under their own names. Without run_id a new one is made for each call.
    """
    inner = inner_columns(graph)
    fields = {"_at": "string", **{n: f.type for n, f in graph.schema.fields.items()}, **inner}
    kind = ", ".join(f"`{n}` {t}" for n, t in fields.items())
    # records are joined as they were saved: the JSON is smaller than what is read from it
    needed = [c for c in dict.fromkeys(("root_id", key, "correlation_id", SEQUENCE, "completed_positions", "state")) if c in records.columns]
    there = lambda name, instead: F.col("_r_" + name) if name in needed else instead
    root = F.coalesce(there("root_id", F.lit(None)), F.col("_r_" + key).cast("string"))
    run_id = run_id or uuid.uuid4().hex[:12]
    last = _who(
        F.concat_ws("~", root, F.lit(run_id)), root, F.col("_r_" + key).cast("string"), F.coalesce(there("correlation_id", F.lit(None)), root),
        there(SEQUENCE, F.lit(0)).cast("long"), F.coalesce(there("completed_positions", F.lit(None)).cast(POSITIONS), F.array().cast(POSITIONS)),
    ) if graph.checkpoints is not None else F.lit(None)
    raw = [F.col(c).alias("_r_" + c) for c in needed]
    name = F.col(rows).cast("string")
    both = df.join(records.select(*raw), name == root, "left")
    both = both.withColumns({"_saved": F.from_json("_r_state", kind, STAMPS), "_last": last}).drop(*("_r_" + c for c in needed))
    have = F.col("_saved").isNotNull()
    made = {n: F.when(have, F.col("_saved")[n]).otherwise(F.col(n)) for n in graph.schema.fields}
    made |= {WAS + c: F.col("_saved")[c] for c in inner}
    if graph.checkpoints is not None:
        fresh = _who(name, name, F.lit(None).cast("string"), name, F.lit(0).cast("long"), F.array().cast(POSITIONS))
        made[RUN] = F.when(have, F.col("_last")).otherwise(fresh)
    start = F.coalesce(F.col("_start"), F.lit(graph.entry))
    ready = both.withColumns({**made, "_start": F.col("_saved")["_at"]}).drop("_saved", "_last")
    if graph.checkpoints is not None:
        ready = graph.checkpoints.above(ready, name, run_id)
    return run(graph, ready, start=start, **options).drop("_start")


def latest(saves: DataFrame, key: str = KEY, sequence: str = SEQUENCE) -> DataFrame:
    """The last save of each key, tombstones left out.

    max_by of the row, so that map-side partial results replace a sort of every save.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in saves.columns))
    last = saves.groupBy(key).agg(F.max_by(whole, F.col(sequence)).alias("_r")).select("_r.*")
    return last.where(F.col(sequence) < 2**62)


def listing(records: DataFrame, correlation: str | None = None, positions: str = "completed_positions") -> DataFrame:
    """Summaries, optionally of one correlation id; order them by last_saved_at for display."""
    out = records if correlation is None else records.where(F.col("correlation_id") == correlation)
    return out.select("invocation_id", "correlation_id", "last_saved_at", F.size(positions).cast("long").alias("completed_node_count"))


def remaining(planned: DataFrame, completed: DataFrame, *keys: str) -> DataFrame:
    """Planned work that isn't completed: an anti-join on the full position."""
    return planned.join(completed.select(*keys).distinct(), list(keys), "left_anti")


def visible_saves(saves: DataFrame, key: str, sequence: Column | str, flush_every: int) -> DataFrame:
    """Per key: how many saves, and how many of them are flushed with batches of flush_every."""
    n = F.count("*")
    return saves.groupBy(key).agg(n.alias("n_saves"), (F.floor(n / flush_every) * flush_every).cast("long").alias("n_flushed"))


def fan_out_progress(instances: DataFrame, *keys: str) -> DataFrame:
    """Counts of instances by state, and the errors kept with completed ones."""
    def of(state: str) -> Column:
        return F.count(F.when(F.col("state") == state, 1)).alias(f"n_{state}")

    return instances.groupBy(*keys).agg(of("completed"), of("in_flight"), of("not_started"), F.count(F.when(F.col("result_is_error"), 1)).alias("n_errors"))


def migrated(records: DataFrame, migrations: Migrations, current: str, fields: Mapping[str, str], version: str = "schema_version") -> DataFrame:
    """Records with their state columns brought to the current version.

    Each version's chain is found on the driver, and a CASE on the version applies it, so all
    versions go through one scan without a shuffle. `fields` has the current schema's column
    types. A version without a chain raises; of those that no step starts from, one is enough.
    """
    named = F.coalesce(F.col(version).cast("string"), F.lit("")).isin(current, *migrations.sources())
    found = records.select(F.col(version).alias("v"), named.alias("named")).groupBy("named", F.when(F.col("named"), F.col("v"))).agg(F.min("v")).collect()
    have = [r[-1] for r in found]
    kept = {n: (F.col(n) if n in records.columns else F.lit(None)).cast(t) for n, t in fields.items()}
    cases: dict[str, Column] = {}
    for v in have:
        state = {c: F.col(c) for c in records.columns}
        for step in migrations.chain(v or "", current):
            try:
                state = {**state, **{k: x if isinstance(x, Column) else F.lit(x) for k, x in step.apply(state).items()}}
            except Exception as e:
                raise CheckpointError("checkpoint_state_migration_failed", f"{step.source!r} to {step.target!r}: {e}") from e
        for n, t in fields.items():
            if n in state:
                cases[n] = cases.get(n, F).when(F.col(version).eqNullSafe(v), state[n].cast(t))
    out = {n: cases[n].otherwise(c) if n in cases else c for n, c in kept.items()}
    rest = [F.col(c) for c in records.columns if c not in fields and c != version]
    return records.select(*rest, *(c.alias(n) for n, c in out.items()), F.lit(current).alias(version))
