"""Streaming queries run to the end of the available events; the results are those of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.streaming import events


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.read_events(spark, sf_dir, "events.parquet")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = events.run_available(events.tumbling(_stream(spark, sf_dir)), "complete")
    return made.withColumn("total", F.round("total", 2))


def stream_idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sessions that ended by an idle day before the watermark behind the last event."""
    return events.run_available(events.idle_sessions(_stream(spark, sf_dir), idle_ms=86_400_000))


def stream_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's clicks with the purchases within six hours after them."""
    return events.run_available(events.joined(_stream(spark, sf_dir), within="6 HOURS"))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_idle_sessions, stream_joined)}
SQL = {
    "stream_tumbling": """SELECT epoch_us(time_bucket(INTERVAL 1 hour, ts)) AS start_us, event_type, count(*) AS events, round(sum(value), 2) AS total
FROM events GROUP BY 1, 2""",
    "stream_idle_sessions": """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN ms - before <= 86400000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ms) AS n FROM e)
SELECT user_id, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS events FROM s GROUP BY user_id, n
HAVING max(ms) + 86400001 <= (SELECT max(epoch_us(ts)) // 1000 - 600000 FROM events)""",
    "stream_joined": """SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b
  ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 hours""",
}
