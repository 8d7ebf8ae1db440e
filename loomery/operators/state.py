"""Superstep state: channel reducers, tasks, checkpoints and their history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.lineage import cut


def _in_order(value: str = "value", order: str = "ord") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])


def last_value(writes: DataFrame, by: tuple[str, ...] = ("step", "channel")) -> DataFrame:
    """One write a step; more raise."""
    rows = writes.groupBy(*by).agg(F.max_by("value", "ord").alias("value"), F.count(F.lit(1)).alias("_n"))
    bad = F.when(F.col("_n") > 1, F.raise_error(F.lit("a last-value channel takes one write a step")))
    return rows.withColumn("_bad", bad).where(F.col("_bad").isNull()).drop("_n", "_bad")


def any_value(writes: DataFrame, by: tuple[str, ...] = ("step", "channel")) -> DataFrame:
    return writes.groupBy(*by).agg(F.max_by("value", "ord").alias("value"))


def topic(writes: DataFrame, accumulate: bool = False, by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """The values (arrays, flattened one level) of each step, or of all steps so far."""
    steps = writes.groupBy(*by, "step").agg(F.flatten(_in_order()).alias("values"))
    if not accumulate:
        return steps
    so_far = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.select(*by, "step", F.flatten(F.collect_list("values").over(so_far)).alias("values"))


def fold(writes: DataFrame, start: Column, reducer: Callable[[Column, Column], Column], by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """A left fold in write order by any two-argument reducer."""
    return writes.groupBy(*by).agg(F.aggregate(_in_order(), start, reducer).alias("value"))


def barrier_ready(writes: DataFrame, names: list[str], by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Whether all named sources have written."""
    seen = F.collect_set("value")
    ready = F.size(F.array_except(F.array(*map(F.lit, names)), seen)) == 0
    return writes.groupBy(*by).agg(ready.alias("ready"))


def due_tasks(triggers: DataFrame, versions: DataFrame, seen: DataFrame) -> DataFrame:
    """Nodes (node, channel) with a channel newer than they have seen, once each."""
    rows = triggers.join(versions, "channel").join(seen, ["node", "channel"], "left")
    return rows.where(F.col("version") > F.coalesce("seen_version", F.lit(0))).select("node").distinct()


def latest_checkpoints(checkpoints: DataFrame, by: tuple[str, ...] = ("thread_id", "checkpoint_ns")) -> DataFrame:
    others = [c for c in checkpoints.columns if c not in by]
    best = checkpoints.groupBy(*by).agg(F.max_by(F.struct(*others), "checkpoint_id").alias("r"))
    return best.select(*by, *[F.col("r")[c].alias(c) for c in others])


def history(checkpoints: DataFrame, thread: str | None = None, before: str | None = None, condition: Column | None = None, limit: int | None = None) -> DataFrame:
    """Snapshots, newest first."""
    rows = checkpoints
    if thread is not None:
        rows = rows.where(F.col("thread_id") == thread)
    if before is not None:
        rows = rows.where(F.col("checkpoint_id") < before)
    if condition is not None:
        rows = rows.where(condition)
    rows = rows.orderBy(F.desc("checkpoint_id"), "thread_id", "checkpoint_ns")
    return rows.limit(limit) if limit is not None else rows


def hydrate(checkpoints: DataFrame, blobs: DataFrame, writes: DataFrame) -> DataFrame:
    """Checkpoints with their channel values (by channel and version) and pending writes, both in order.

    ``checkpoints``: thread_id, checkpoint_ns, checkpoint_id, versions map<string, string>.
    """
    key = ["thread_id", "checkpoint_ns"]
    own = [*key, "checkpoint_id"]
    asked = checkpoints.select(*own, F.explode("versions").alias("channel", "version"))
    values = asked.join(blobs, [*key, "channel", "version"]).groupBy(*own)
    values = values.agg(F.array_sort(F.collect_list(F.struct("channel", "blob"))).alias("channel_values"))
    pending = writes.groupBy(*own).agg(
        F.array_sort(F.collect_list(F.struct("task_id", "idx", "channel", "blob"))).alias("pending_writes")
    )
    return checkpoints.join(values, own, "left").join(pending, own, "left")


def put_writes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Writes are idempotent by (checkpoint, task, idx): the first wins, but for special idx below 0 the last."""
    key = ["thread_id", "checkpoint_ns", "checkpoint_id", "task_id", "idx"]
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = F.when(F.col("idx") < 0, -F.col("_new")).otherwise(F.col("_new"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return both.withColumn("_r", rank).where("_r = 1").drop("_new", "_r")


def run_supersteps(
    state: dict[str, DataFrame],
    plan: Callable[[int, dict[str, DataFrame]], list[Callable]],
    limit: int = 25,
) -> tuple[dict[str, DataFrame], str]:
    """Run tasks in steps until none is due ("done") or the limit is reached ("out_of_steps").

    ``plan`` gives the tasks of a step; a task maps the state before the step to channel
    updates.  Lineage is cut by a reliable checkpoint after each step, so steps do not pile
    up in one plan and lost executors cost one step at most.
    """
    for step in range(limit):
        tasks = plan(step, state)
        if not tasks:
            return state, "done"
        updates: dict[str, DataFrame] = {}
        for task in tasks:
            for channel, frame in task(state).items():
                if channel in updates:
                    raise ValueError(f"two tasks write channel {channel!r} in step {step}")
                updates[channel] = frame
        state = state | {channel: cut(frame) for channel, frame in updates.items()}
    return state, "out_of_steps"
