"""Folds over very many writes in order, without a list a channel.

Writes have their channel (``by``), an order that is unique in a channel, and a value.  A reducer
with a known way to join partial results (sum, count, min, max, first, last) is a partial
aggregate.  For its value after every single write rows are dealt into ranges of (channel, order), so that a
channel with a third of all writes is many ranges; each range is summed on its own, and the sums
of the ranges before it, a row a range, come back to the channel's later ranges.  Any other
reducer is a function of two values, called along a sorted stream that holds one value a channel.

Defined results: nulls are passed over by min, max, sum, count, first and last, as SQL does (a
channel of nulls has null, count 0); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.lineage import cut

KINDS = ("sum", "count", "min", "max", "first", "last")


def _whole(kind: str, value: str, order: tuple[str, ...]) -> Column:
    place = F.when(F.col(value).isNotNull(), F.struct(*order))  # nulls are no first or last value
    makers = {
        "sum": lambda: F.sum(value), "count": lambda: F.count(value), "min": lambda: F.min(value), "max": lambda: F.max(value),
        "first": lambda: F.min_by(value, place), "last": lambda: F.max_by(value, place),
    }
    if kind not in makers:
        raise ValueError(f"unknown reducer: {kind}")
    return makers[kind]()


def _joined(kind: str, before: Column, own: Column) -> Column:
    """The result over two stretches, one after the other."""
    both = {"sum": lambda: before + own, "count": lambda: before + own, "min": lambda: F.least(before, own), "max": lambda: F.greatest(before, own)}
    if kind == "last":
        return F.coalesce(own, before)
    return F.coalesce(both[kind](), before, own) if kind in both else F.coalesce(before, own)


def reduced(writes: DataFrame, made: dict[str, tuple[str, str]], by: tuple[str, ...] = ("channel",), order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Per channel each named (kind, column); partial before it moves."""
    return writes.groupBy(*by).agg(*[_whole(kind, value, order).alias(name) for name, (kind, value) in made.items()])


def running(writes: DataFrame, made: dict[str, tuple[str, str]], by: tuple[str, ...] = ("channel",), order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The writes with each named (kind, column) over all writes of their channel up to their own."""
    placed = cut(writes.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    window = {
        "sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
        "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True),
    }
    rows = placed.withColumns({f"_own_{name}": window[kind](value).over(inside) for name, (kind, value) in made.items()})
    sums = placed.groupBy("_part", *by).agg(*[_whole(kind, value, order).alias(name) for name, (kind, value) in made.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    over = {
        "sum": F.sum, "count": F.sum, "min": F.min, "max": F.max,
        "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True),
    }
    # A name of its own: the caller's may be any, so none of theirs is overwritten.
    carried = sums.withColumn("_nth_range", F.row_number().over(Window.partitionBy(*by).orderBy("_part")))
    carried = carried.select("_part", *by, "_nth_range", *[over[kind](name).over(earlier).alias(f"_before_{name}") for name, (kind, _) in made.items()])
    # Ranges follow each other, so fewer channels go on into a further range than there are ranges.
    carried = carried.where("_nth_range > 1").select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], *[f"_before_{n}" for n in made])
    same = [F.col("_part") == F.col("_p"), *[F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]]
    joined = rows.join(F.broadcast(carried), same, "left")
    return joined.select(*writes.columns, *[_joined(kind, F.col(f"_before_{n}"), F.col(f"_own_{n}")).alias(n) for n, (kind, _) in made.items()])


def rising(rows: DataFrame, time: str, order: tuple[str, ...], into: str) -> DataFrame:
    """``rows`` with their whole-number times made strictly rising in an order: a time not after the one before is that plus one.

    With the rows' numbers n that is n plus the highest of (time - n) so far, a running maximum, so no task sees all rows.
    Rows equal in the order keep their numbers' order in the maximum, so that their times rise too.
    """
    counted = running(rows, {"_n": ("count", time)}, (), order)
    highest = running(counted.withColumn("_ahead", F.col(time) - F.col("_n")), {"_top": ("max", "_ahead")}, (), (*order, "_n"))
    return highest.withColumn(into, F.col("_top") + F.col("_n")).drop("_n", "_ahead", "_top")


def folded(
    writes: DataFrame, start, reducer: Callable, kind: str, by: tuple[str, ...] = ("channel",), order: tuple[str, ...] = ("ord",), value: str = "value"
) -> DataFrame:
    """Per channel the left fold by any function of (value so far, next value); ``kind``: the result's type.

    One channel's writes are one after the other by the nature of such a reducer: a sorted stream, of which
    a value a channel is held.
    """
    keys = list(by)
    types = ", ".join(f"k{i} {writes.schema[c].dataType.simpleString()}" for i, c in enumerate(keys))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state, begun = None, start, False
        for batch in batches:
            done = []
            columns = [batch[f"k{i}"].tolist() for i in range(len(keys))]
            for row, x in zip(zip(*columns), batch["v"].tolist()):
                row = tuple(None if c != c else c for c in row)
                if not begun or row != own:
                    if begun:
                        done.append((*own, state))
                    own, state, begun = row, start, True
                state = reducer(state, x)
            yield pd.DataFrame(done, columns=names)
        if begun:
            yield pd.DataFrame([(*own, state)], columns=names)

    names = [*(f"k{i}" for i in range(len(keys))), "value"]
    rows = writes.repartition(*keys).sortWithinPartitions(*keys, *order)
    rows = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.col(value).alias("v"))
    made = rows.mapInPandas(stream, f"{types}, value {kind}")
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], "value")


def topic_values(writes: DataFrame, accumulate: bool = False, by: tuple[str, ...] = ("channel",), order: str = "ord") -> DataFrame:
    """The values of a topic, a row each: by, step, place, value.  ``value`` of the writes is a list, flattened one level.

    Places begin at 0 in each step; with ``accumulate`` they run on over a channel's steps, and
    what a step has is every value below :func:`topic_sizes`' n.
    """
    own, place = (by, ("step", order)) if accumulate else ((*by, "step"), (order,))
    sized = writes.select(*by, "step", order, "value", F.coalesce(F.size("value"), F.lit(0)).alias("size"))
    sized = running(sized.withColumn("size", F.greatest("size", F.lit(0))), {"upto": ("sum", "size")}, own, place)
    rows = sized.select(*by, "step", (F.col("upto") - F.col("size")).alias("first"), F.posexplode("value").alias("i", "value"))
    return rows.select(*by, "step", (F.col("first") + F.col("i")).alias("place"), "value")


def topic_sizes(writes: DataFrame, by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """(by, step, n): how many values a topic has gathered when a step ends."""
    steps = writes.groupBy(*by, "step").agg(F.sum(F.greatest(F.size("value"), F.lit(0))).alias("own"))
    return running(steps, {"n": ("sum", "own")}, by, ("step",)).select(*by, "step", "n")
