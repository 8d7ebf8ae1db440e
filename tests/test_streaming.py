"""Streams give the rows of a batch, file by file, and after a restart."""

import shutil

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomery.streaming import events

SF = "/root/testdata/sf0.001"
DAY = 86_400_000


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in four folders, by time."""
    root = tmp_path_factory.mktemp("events")
    rows = spark.read.parquet(f"{SF}/events.parquet")
    quarter = F.ntile(4).over(Window.orderBy("ts", "event_id"))
    rows = rows.withColumn("q", quarter).cache()
    for q in range(1, 5):
        rows.where(F.col("q") == q).drop("q").coalesce(1).write.parquet(str(root / f"q{q}"))
    return root, rows.drop("q")


def _add(folder, parts, q):
    folder.mkdir(exist_ok=True)
    for f in (parts / f"q{q}").glob("*.parquet"):
        shutil.copy(f, folder / f"{q}_{f.name}")


def test_sessions_and_deduplication(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").where("user_id < 5")
    rows.unionByName(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"))
    once = events.run_available(events.deduplicated(stream, late="30 days"), output="append")
    assert once.count() == rows.count()
    made = events.run_available(events.sessions(stream), output="complete")
    assert made.agg(F.sum("events")).first()[0] == 2 * rows.count()


def _idle(rows, last):
    """Sessions by a plain loop, those that the watermark closes."""
    out, by_user = set(), {}
    for r in rows:
        by_user.setdefault(r["user_id"], []).append(r["ms"])
    for u, times in by_user.items():
        times.sort()
        own = [[times[0]]]
        for t in times[1:]:
            own[-1].append(t) if t - own[-1][-1] <= DAY else own.append([t])
        out |= {(u, s[0], s[-1], len(s)) for s in own if s[-1] + DAY + 1 <= last - 600_000}
    return out


def test_a_stream_that_is_started_again_goes_on(spark, parts, tmp_path):
    root, rows = parts
    folder, path = tmp_path / "in", str(tmp_path / "out")
    stream = lambda: events.idle_sessions(events.read_events(spark, str(folder), per_batch=1), idle_ms=DAY)
    for q in (1, 2):
        _add(folder, root, q)
    first = events.run_available(stream(), path=path).count()
    for q in (3, 4):
        _add(folder, root, q)
    made = events.run_available(stream(), path=path)
    got = [tuple(r) for r in made.collect()]
    all_rows = rows.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).collect()
    assert len(got) == len(set(got)) and set(got) == _idle(all_rows, max(r["ms"] for r in all_rows))
    assert first <= len(got) and events.run_available(stream(), path=path).count() == len(got)  # nothing new, nothing twice


def test_streams_are_joined_within_a_time(spark, parts, tmp_path):
    root, rows = parts
    for q in range(1, 5):
        _add(tmp_path / "in", root, q)
    made = events.run_available(events.joined(events.read_events(spark, str(tmp_path / "in"), per_batch=2), within="2 DAYS"))
    a, b = rows.where("event_type = 'click'").alias("a"), rows.where("event_type = 'purchase'").alias("b")
    want = a.join(b, F.expr("a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 DAYS")).select("a.user_id", "a.event_id", "b.event_id")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect())) and made.count() > 0
