"""Dataflow over threads: channel kinds, edges, sends and the cache, on rows whose results are plain."""

import pytest

from loomery.operators import dataflow


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_several_writers_meet_by_the_channel_s_kind(spark):
    state = _frame(spark, [("t", "total", 5, 1), ("t", "note", 9, 2), ("t", "once", 4, 3)], "thread string, channel string, value long, version long")
    writes = _frame(spark, [("t", 2, "total", 3), ("t", 1, "total", 2), ("t", 1, "seen", 7), ("t", 2, "seen", 8)], "thread string, path int, channel string, value long")
    kinds = {"total": "sum", "seen": "any", "note": "untracked", "once": "ephemeral"}
    made = dataflow.apply_writes(state, writes, kinds)
    got = {r["channel"]: (r["value"], r["version"]) for r in made.collect()}
    assert got == {"total": (10, 4), "seen": (8, 4), "note": (9, 2), "once": (None, 3)}
    assert {r["channel"] for r in dataflow.saved(made, kinds).collect()} == {"total", "seen"}
    with pytest.raises(ValueError):
        dataflow.apply_writes(state, writes, {"total": "median"})
    with pytest.raises(Exception, match="one write a step"):
        dataflow.apply_writes(state, writes, {"seen": "last"}).collect()


def test_waiting_edges_need_all_their_sources(spark):
    done = _frame(spark, [(1, "a"), (1, "b"), (2, "a"), (2, "a")], "thread int, node string")
    edges = _frame(spark, [("a", "x")], "source string, target string")
    waiting = _frame(spark, [("a", "y"), ("b", "y")], "source string, target string")
    assert {tuple(r) for r in dataflow.follow_edges(done, edges, waiting).collect()} == {(1, "x"), (2, "x"), (1, "y")}


def test_retry_delays_grow_to_a_bound(spark):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(1, 12).select(dataflow.retry_delay(F.col("id"))).collect()]
    assert got[:3] == [0.5, 1.0, 2.0] and got[-1] == 128.0


def test_expired_entries_are_misses_and_sets_replace(spark):
    cache = _frame(spark, [("n", "a", 1, None), ("n", "b", 2, 5.0), ("m", "a", 3, 50.0)], "namespace string, key string, value long, expires double")
    asked = _frame(spark, [("n", "a"), ("n", "b"), ("m", "a"), ("m", "z")], "namespace string, key string")
    found = dataflow.cache_get(cache, asked, 10.0)
    assert {(r["namespace"], r["key"], r["hit"]) for r in found.collect()} == {("n", "a", True), ("n", "b", False), ("m", "a", True), ("m", "z", False)}
    assert tuple(dataflow.cache_statistics(found).first()) == (2, 2, 0.5)
    assert tuple(dataflow.cache_statistics(found.where("false")).first()) == (0, 0, 0.0)
    new = _frame(spark, [("n", "a", 9, 5.0)], "namespace string, key string, value long, ttl double")
    left = {(r["namespace"], r["key"]): (r["value"], r["expires"]) for r in dataflow.cache_set(dataflow.cache_clear(cache, ("m",)), new, 10.0).collect()}
    assert left == {("n", "a"): (9, 15.0)}


def test_numbers_are_dense_over_ranges(spark):
    from loomery.operators.numbering import numbered

    rows = spark.range(1000).selectExpr("cast(id * 7919 % 1000 as string) as name").repartition(7)
    got = [(r["name"], r["n"]) for r in numbered(rows, "n", "name").collect()]
    assert sorted(got, key=lambda x: x[1]) == list(zip(sorted(x for x, _ in got), range(1, 1001)))


def test_canonical_uris(spark):
    from pyspark.sql import functions as F

    from loomery.functions import text

    rows = [("repo", "https://h/r", "v1", "a/b.sh", "L4"), ("file", "./x", None, None, None), ("file", "/x", None, None, "L1"), ("s3", "b/k", None, None, "page=2")]
    frame = _frame(spark, rows, "s string, l string, r string, p string, a string")
    uri = text.canonical_uri(*map(F.col, "slrpa"))
    assert [r[0] for r in frame.select(uri).collect()] == ["repo:https://h/r#v1:a/b.sh#L4", "file:./x", "file:///x#L1", "s3://b/k#page=2"]
    with pytest.raises(Exception, match="only a repository"):
        _frame(spark, [("db", "x", "v", None, None)], frame.schema).select(uri).collect()
