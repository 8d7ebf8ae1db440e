"""URL filtering by a sort-merge range join over reversed-host keys.

A host's key is its labels reversed and each ended by a dot (``www.example.org`` is
``org.example.www.``).  A rule's host then covers exactly the keys that begin with its
own key: an interval.  Such intervals are nested or apart, so one sweep over rules and
URLs sorted by key keeps the active rules on a stack; the path prefixes of the active
hosts decide, longest rule (host and path together) first, the longer host on a tie.

URLs are dealt into ranges of (key, hash of the URL), so one host with a third of all
rows still spreads over many ranges; a rule is copied into the ranges it meets.  The
ranges' bounds are the only thing gathered, one row a range.

Defined results: a null URL or one without ``://`` has an empty host and path and meets
no rule; rules with a null host or path are ignored; equal rules keep the smallest
verdict; repeated rows are kept.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Sweep:
    """The stack of rule hosts that cover the current key."""

    def __init__(self) -> None:
        self.part, self.stack = None, []

    def enter(self, part: int, key: str) -> None:
        if part != self.part:
            self.part, self.stack = part, []
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, part: int, key: str, host: str, path: str, verdict: str) -> None:
        self.enter(part, key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, host, {}))
        self.stack[-1][2].setdefault(path, verdict)

    def match(self, part: int, key: str, path: str) -> tuple[str | None, str | None]:
        self.enter(part, key)
        best, found = (-1, -1), (None, None)
        for _key, host, paths in self.stack:
            for size in {len(p) for p in paths}:
                rank = (len(host) + size, len(host))
                if rank > best and len(path) >= size and (verdict := paths.get(path[:size])) is not None:
                    best, found = rank, (host + path[:size], verdict)
        return found


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
    parts: int | None = None,
) -> DataFrame:
    """Judge every URL by ``rules`` (host, path, verdict): key, host, path, rule, verdict.

    ``rule`` is host and path of the longest rule that fits, or null; then ``default`` holds.
    """
    parts = parts or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = pages.select(key).schema[0].dataType.simpleString()
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url")).select(
        "id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64("url", "id").alias("h")
    )
    salted = F.concat_ws("\x01", "key", F.lpad(F.hex("h"), 16, "0"))
    rows = rows.withColumn("key", host_key(F.col("host"))).withColumn("place", salted).drop("h")
    ends = rows.select("place").repartitionByRange(parts, "place").groupBy(F.spark_partition_id()).agg(F.min("place"))
    bounds = sorted(row[1].encode() for row in ends.collect())[1:]

    @F.pandas_udf("int")
    def part_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for places in batches:
            yield pd.Series([bisect_right(bounds, p.encode()) for p in places], dtype="int32")

    first = rules.where("host is not null and path is not null").select(
        F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict"
    )
    first = first.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("key", host_key(F.col("host")))
    # Every key that begins with "org." lies from "org." to before "org/", "/" being the character after ".".
    beyond = F.expr("concat(substring(key, 1, length(key) - 1), '/')")
    spread = first.withColumn("part", F.explode(F.sequence(part_of(F.col("key")), part_of(beyond))))
    none = F.lit(None)
    both = rows.select(
        part_of(F.col("place")).alias("part"), "key", F.lit(1).alias("kind"), "id", "host", "path",
        none.cast("string").alias("verdict"),
    ).unionByName(
        spread.select("part", "key", F.lit(0).alias("kind"), none.cast(kind).alias("id"), "host", "path", "verdict")
    )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Sweep()
        for batch in batches:
            rules_, verdicts, keep = [], [], []
            columns = (batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6))
            for i, (part, at, kind_, host, path, verdict) in enumerate(zip(*columns)):
                if kind_ == 0:
                    state.rule(part, at, host, path, verdict)
                    continue
                rule, verdict = state.match(part, at, path)
                keep.append(i)
                rules_.append(rule)
                verdicts.append(default if rule is None else verdict)
            kept = batch.take(pa.array(keep, pa.int32()))
            yield pa.record_batch(
                [kept.column(3), kept.column(4), kept.column(5), pa.array(rules_, pa.string()), pa.array(verdicts, pa.string())],
                names=["id", "host", "path", "rule", "verdict"],
            )

    swept = (
        both.repartition(parts, "part")
        .sortWithinPartitions("part", "key", "kind")
        .mapInArrow(sweep, f"id {kind}, host string, path string, rule string, verdict string")
    )
    return swept.withColumnRenamed("id", key)
