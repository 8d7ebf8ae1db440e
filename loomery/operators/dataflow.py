"""A dataflow over very many threads at once: channels, edges, sends, resumption and forks as table operations.

One superstep of every thread is one plan: a thread is a key, a channel a row, a task a row.
Nothing here loops on the driver; ``state.run_supersteps`` is for a single flow whose tasks are
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a channel takes the writes of one step.  The first four keep their value when none comes.
KINDS = ("last", "any", "sum", "max", "untracked", "ephemeral")


def _choice(names: dict[str, str], column: str = "channel") -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(column))


def apply_writes(state: DataFrame, writes: DataFrame, kinds: dict[str, str], strict: bool = True) -> DataFrame:
    """State (thread, channel, value, version) after one step's writes (thread, path, channel, value).

    Several tasks may write one channel: the writes meet in the order of their task's path,
    by the channel's kind.  ``last`` takes one write a step (more are an error if ``strict``),
    ``any`` the last of them, ``sum`` and ``max`` fold them into the value before, ``untracked``
    is ``any`` that is never saved, and ``ephemeral`` is gone after a step without a write.
    Written channels get the thread's highest version plus one; sums are partial before they move.
    """
    if unknown := set(kinds.values()) - set(KINDS):
        raise ValueError(f"unknown channel kinds: {sorted(unknown)}")
    new = writes.groupBy("thread", "channel").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("value").alias("_sum"), F.max("value").alias("_max"), F.max_by("value", "path").alias("_last")
    )
    top = state.groupBy("thread").agg(F.max("version").alias("_top"))
    rows = state.join(new, ["thread", "channel"], "full").join(top, "thread", "left").withColumn("_kind", F.coalesce(_choice(kinds), F.lit("any")))
    written = F.col("_n").isNotNull()
    folded = (
        F.when(F.col("_kind") == "sum", F.coalesce("value", F.lit(0)) + F.col("_sum"))
        .when(F.col("_kind") == "max", F.greatest("value", "_max"))
        .otherwise(F.col("_last"))
    )
    value = F.when(written, folded).when(F.col("_kind") != "ephemeral", F.col("value"))
    if strict:
        twice = (F.col("_kind") == "last") & (F.col("_n") > 1)
        rows = rows.withColumn("_n", F.when(twice, F.raise_error(F.lit("a last-value channel takes one write a step")).cast("long")).otherwise(F.col("_n")))
    version = F.when(written, F.coalesce("_top", F.lit(0)) + 1).otherwise(F.col("version"))
    return rows.select("thread", "channel", value.alias("value"), version.alias("version"))


def saved(state: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """What a checkpoint holds: no untracked channels, no empty ones."""
    return state.where((F.coalesce(_choice(kinds), F.lit("any")) != "untracked") & F.col("value").isNotNull())


def after_finish(writes: DataFrame, finished: DataFrame) -> DataFrame:
    """Channels (thread, channel, value) that show their last write only once their thread has finished."""
    last = writes.groupBy("thread", "channel").agg(F.max_by("value", "path").alias("value"))
    return last.join(finished.select("thread").distinct(), "thread", "left_semi")


def follow_edges(done: DataFrame, edges: DataFrame, waiting: DataFrame) -> DataFrame:
    """Tasks (thread, node) due after ``done`` (thread, node).

    ``edges``: source, target; ``waiting``: source, target, of which a target is due when all
    its sources are done.  Both are the graph, which is small whatever the data.
    """
    done = done.select("thread", "node").distinct()
    plain = done.join(edges, F.col("node") == F.col("source")).select("thread", F.col("target").alias("node"))
    needed = waiting.groupBy("target").agg(F.count_distinct("source").alias("_needed"))
    seen = done.join(waiting.distinct(), F.col("node") == F.col("source")).groupBy("thread", "target").agg(F.count(F.lit(1)).alias("_seen"))
    joined = seen.join(needed, "target").where("_seen = _needed").select("thread", F.col("target").alias("node"))
    return plain.unionByName(joined).distinct()


def branch(state: DataFrame, routes: list[tuple[Column, str]], otherwise: str = "end") -> DataFrame:
    """Each row's next node: the first route whose condition holds; adds ``node``."""
    node = F.lit(otherwise)
    for condition, name in reversed(routes):
        node = F.when(condition, name).otherwise(node)
    return state.withColumn("node", node)


def send(rows: DataFrame, node: str, items: Column) -> DataFrame:
    """One task an item, each with its own input: thread, step, node, place, input, task_id (deterministic)."""
    tasks = rows.select("thread", "step", F.lit(node).alias("node"), F.posexplode(items).alias("place", "input"))
    parts = [F.col(c).cast("string") for c in ("thread", "step", "node", "place")]
    return tasks.withColumn("task_id", F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def node_inputs(state: DataFrame, reads: DataFrame) -> DataFrame:
    """(thread, node, input map) of nodes (node, channel, needed): filled channels only; a node lacking a needed one does not run."""
    threads = state.select("thread").distinct()
    filled = state.where("value is not null").select("thread", "channel", "value")
    asked = threads.join(reads).join(filled, ["thread", "channel"], "left")
    entry = F.when(F.col("value").isNotNull(), F.struct("channel", "value"))
    rows = asked.groupBy("thread", "node").agg(
        F.bool_and(~F.col("needed") | F.col("value").isNotNull()).alias("_runs"), F.array_sort(F.collect_list(entry)).alias("_entries")
    )
    return rows.where(F.col("_runs") & (F.size("_entries") > 0)).select("thread", "node", F.map_from_entries("_entries").alias("input"))


def interrupts(tasks: DataFrame, versions: DataFrame, seen: DataFrame, nodes: tuple[str, ...]) -> DataFrame:
    """Tasks (thread, node) to stop at: in ``nodes`` (``*`` for all), in threads with a version beyond what was seen."""
    moved = versions.join(seen, ["thread", "channel"], "left").where(F.col("version") > F.coalesce("seen_version", F.lit(0)))
    listed = tasks if "*" in nodes else tasks.where(F.col("node").isin(*nodes))
    return listed.join(moved.select("thread").distinct(), "thread", "left_semi")


def resumed(tasks: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks still to run, writes to replay): a task with pending writes (task_id) has finished and is not run again."""
    return tasks.join(pending.select("task_id").distinct(), "task_id", "left_anti"), pending.join(tasks.select("task_id"), "task_id", "left_semi")


def fork(checkpoints: DataFrame, at: DataFrame, updates: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """New state of threads forked at a checkpoint: the saved channels of ``at`` (thread, checkpoint_id) with ``updates`` applied.

    ``checkpoints``: thread, checkpoint_id, channel, value, version.  Adds ``parent``, the checkpoint left.
    """
    old = checkpoints.join(at, ["thread", "checkpoint_id"], "left_semi")
    made = apply_writes(old.select("thread", "channel", "value", "version"), updates, kinds, strict=False)
    return made.join(at.select("thread", F.col("checkpoint_id").alias("parent")), "thread")


def delete_threads(rows: DataFrame, threads: DataFrame) -> DataFrame:
    """Any table of threads without all rows of some of them."""
    return rows.join(threads.select("thread").distinct(), "thread", "left_anti")


def stream_updates(log: DataFrame) -> DataFrame:
    """Mode "updates": the rows of a log (thread, step, channel, value) whose value is not that of the channel before."""
    own = Window.partitionBy("thread", "channel").orderBy("step")
    return log.withColumn("_old", F.lag("value").over(own)).where(~F.col("value").eqNullSafe(F.col("_old"))).drop("_old")


def stream_values(log: DataFrame) -> DataFrame:
    """Mode "values": after each step of a thread every channel written so far, with its value then."""
    steps = log.select("thread", "step").distinct()
    channels = log.groupBy("thread", "channel").agg(F.min("step").alias("_first"))
    grid = steps.join(channels, "thread").where("step >= _first").select("thread", "step", "channel")
    own = Window.partitionBy("thread", "channel").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.join(log, ["thread", "step", "channel"], "left").withColumn("value", F.last("value", ignorenulls=True).over(own))


def retry_delay(attempt: Column, first: float = 0.5, factor: float = 2.0, most: float = 128.0) -> Column:
    """Seconds to wait after the n-th failed attempt, without jitter."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(factor), attempt - 1))


# A result cache: rows of namespace, key, value, expires (seconds; null: never).


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def cache_get(cache: DataFrame, asked: DataFrame, now: float) -> DataFrame:
    """``asked`` (namespace, key) with value and hit; an expired entry is none."""
    live = cache.where(F.col("expires").isNull() | (F.lit(now) < F.col("expires"))).select("namespace", "key", "value", F.lit(True).alias("hit"))
    return asked.join(live, ["namespace", "key"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_set(cache: DataFrame, entries: DataFrame, now: float) -> DataFrame:
    """The cache with entries (namespace, key, value, ttl or null) in place of older ones; expired ones go."""
    new = entries.select("namespace", "key", "value", (F.lit(now) + F.col("ttl")).alias("expires"))
    old = cache.where(F.col("expires").isNull() | (F.lit(now) < F.col("expires"))).join(new, ["namespace", "key"], "left_anti")
    return old.select("namespace", "key", "value", "expires").unionByName(new)


def cache_clear(cache: DataFrame, namespaces: tuple[str, ...] = ()) -> DataFrame:
    return cache.where(~F.col("namespace").isin(*namespaces)) if namespaces else cache.where("false")


def cache_statistics(lookups: DataFrame) -> DataFrame:
    """One row: hits, misses, hit_rate."""
    hits, all_ = F.count_if("hit"), F.count(F.lit(1))
    return lookups.agg(hits.alias("hits"), (all_ - hits).alias("misses"), F.coalesce(F.round(hits / F.nullif(all_, F.lit(0)), 4), F.lit(0.0)).alias("hit_rate"))


def local_reads(state: DataFrame, tasks: DataFrame, writes: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """What each task (thread, node) reads before its step ends: the state with its own writes (thread, node, path, channel, value)."""
    own = F.struct("thread", "node").alias("thread")
    seen = tasks.select("thread", "node").distinct().join(state, "thread").select(own, "channel", "value", "version")
    mine = writes.select(own, "path", "channel", "value")
    # Nothing is gone before the step ends.
    lasting = {c: "any" if kind == "ephemeral" else kind for c, kind in kinds.items()}
    made = apply_writes(seen, mine, lasting, strict=False)
    return made.select("thread.thread", "thread.node", "channel", "value")


# The channels that commands write.
GOTO, RESUME = "branch:to:", "__resume__"


def command_writes(commands: DataFrame) -> DataFrame:
    """Commands (thread, goto array, resume, update map; any may be null) as writes (thread, path, channel, value), texts all."""
    entry = lambda channel, value: F.struct(channel.alias("channel"), value.cast("string").alias("value"))
    goto = F.transform(F.coalesce("goto", F.array().cast("array<string>")), lambda n: entry(F.concat(F.lit(GOTO), n), F.lit("__start__")))
    resume = F.filter(F.array(entry(F.lit(RESUME), F.col("resume"))), lambda x: x["value"].isNotNull())
    given = F.coalesce(F.map_entries("update"), F.array().cast("array<struct<key:string,value:string>>"))
    update = F.transform(given, lambda e: entry(e["key"], e["value"]))
    return commands.select("thread", F.posexplode(F.concat(goto, resume, update)).alias("path", "w")).select("thread", "path", "w.*")


def call_tools(calls: DataFrame, tools: dict) -> DataFrame:
    """Tool calls (call_id, name, input) with output and status: each by the function of its name, batch by batch.

    An unknown name or a failing call is an output of status ``error``, not a failed task.
    """

    def run(batches):
        for batch in batches:
            outputs, states = [], []
            for name, given in zip(batch["name"], batch["input"]):
                try:
                    if name not in tools:
                        raise KeyError(f"no tool of the name {name}")
                    outputs.append(str(tools[name](given)))
                    states.append("success")
                except Exception as failure:  # noqa: BLE001  any failure of a user's function is its output
                    outputs.append(f"{type(failure).__name__}: {failure}")
                    states.append("error")
            yield batch.assign(output=outputs, status=states)

    kind = calls.schema["call_id"].dataType.simpleString()
    return calls.select("call_id", "name", "input").mapInPandas(run, f"call_id {kind}, name string, input string, output string, status string")
