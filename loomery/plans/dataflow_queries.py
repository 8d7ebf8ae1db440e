"""Dataflow and cache queries: a user's events are a thread, event types its channels and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import dataflow, ordered, state
from loomery.plans.common import table

KINDS = {"click": "sum", "view": "any", "error": "ephemeral", "purchase": "max", "signup": "untracked"}
EDGES = "VALUES ('click', 'rank'), ('view', 'rank'), ('error', 'repair')"
WAITING = "VALUES ('click', 'settle'), ('purchase', 'settle'), ('signup', 'welcome'), ('view', 'welcome'), ('error', 'welcome')"
READS = """VALUES ('rank', 'click', true), ('rank', 'view', false), ('settle', 'purchase', true), ('settle', 'signup', true),
  ('repair', 'error', false)"""
NOW = 1704844800
#: Events since then are the writes of a step, new cache entries and pending writes; all before are what stood.
SINCE = "2024-01-30"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("thread"), F.col("event_type").alias("channel"), "event_id", (F.col("event_id") % 100).alias("value"),
        (F.col("ts") >= F.lit(SINCE).cast("timestamp")).alias("late"), F.dayofmonth("ts").alias("day"),
    )


def _latest(events: DataFrame) -> DataFrame:
    return events.groupBy("thread", "channel").agg(F.max_by("value", "event_id").alias("value"), F.count(F.lit(1)).alias("version"))


def _daily(events: DataFrame) -> DataFrame:
    """A thread a user and day."""
    return events.withColumn("thread", F.col("thread") * 100 + F.col("day"))


def _state_and_writes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, sf_dir)
    return _latest(e.where("not late")), e.where("late").withColumnRenamed("event_id", "path")


def step_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.apply_writes(*_state_and_writes(spark, sf_dir), KINDS)


def step_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.saved(step_writes(spark, sf_dir), KINDS)


def step_after_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumnRenamed("event_id", "path")
    return dataflow.after_finish(e, e.where("channel = 'purchase' and value > 80"))


def edge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _daily(_events(spark, sf_dir)).select("thread", F.col("channel").alias("node"))
    listed = lambda sql: spark.sql(f"SELECT * FROM {sql} AS t(source, target)")
    return dataflow.follow_edges(done, listed(EDGES), listed(WAITING))


def branch_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = dataflow.branch(_latest(_events(spark, sf_dir)), [(F.col("value") >= 90, "review"), ((F.col("channel") == "error") & (F.col("value") > 10), "repair")])
    return routed.groupBy("channel", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def send_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("step", F.col("event_id") % 20)
    sent = dataflow.send(rows.withColumn("thread", F.col("event_id")), "worker", F.sequence(F.lit(1), F.col("value") % 3 + 1))
    return sent.select("thread", "step", "place", "input", "task_id")


def node_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = spark.sql(f"SELECT * FROM {READS} AS t(node, channel, needed)")
    made = dataflow.node_inputs(_latest(_daily(_events(spark, sf_dir))), reads)
    entries = F.transform(F.array_sort(F.map_entries("input")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return made.select("thread", "node", F.array_join(entries, ",").alias("input"))


def interrupt_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    versions = e.groupBy("thread", "channel").agg(F.max("event_id").alias("version"))
    seen = e.where("not late").groupBy("thread", "channel").agg(F.max("event_id").alias("seen_version"))
    tasks = e.select("thread", F.col("channel").alias("node")).distinct()
    return dataflow.interrupts(tasks, versions.where("channel = 'error'"), seen, ("purchase", "signup"))


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks (a user's channel) to run again, and the writes replayed instead of the others."""
    e = _events(spark, sf_dir).withColumn("task_id", F.concat_ws(":", F.col("thread").cast("string"), "channel"))
    tasks = e.select("task_id", "channel").distinct()
    pending = e.where("late").select("task_id", "value")
    todo, replay = dataflow.resumed(tasks, pending)
    left = todo.groupBy("channel").agg(F.count(F.lit(1)).alias("to_run"))
    done = replay.join(tasks, "task_id").groupBy("channel").agg(F.count(F.lit(1)).alias("replayed"), F.sum("value").alias("total"))
    return left.join(done, "channel", "full").select(
        "channel", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("to_run", "replayed", "total")]
    )


def fork_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads forked at their first checkpoint (one every fifty values) with one write as a node."""
    rows = _events(spark, sf_dir).withColumn("checkpoint_id", F.floor(F.col("event_id") / 50))
    saved = rows.groupBy("thread", "checkpoint_id", "channel").agg(F.max_by("value", "event_id").alias("value"), F.count(F.lit(1)).alias("version"))
    at = saved.groupBy("thread").agg(F.min("checkpoint_id").alias("checkpoint_id"))
    updates = at.select("thread", F.lit("click").alias("channel"), F.lit(0).alias("path"), F.lit(7).cast("long").alias("value"))
    return dataflow.fork(saved, at, updates, KINDS)


def delete_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    left = dataflow.delete_threads(e, e.where("channel = 'signup' and value < 5"))
    return left.groupBy("thread").agg(F.count(F.lit(1)).alias("n"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("step", F.floor(F.col("event_id") / 500)).withColumn("thread", F.col("thread") % 20)
    return rows.groupBy("thread", "step", "channel").agg((F.max("event_id") % 3).alias("value"))


def stream_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.stream_updates(_log(spark, sf_dir))


def stream_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.stream_values(_log(spark, sf_dir))


def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each error's retries would wait in all, were its number the count of attempts."""
    e = _events(spark, sf_dir).where("channel = 'error'").select("event_id", F.explode(F.sequence(F.lit(1), F.col("value") % 10 + 1)).alias("attempt"))
    return e.groupBy("event_id").agg(F.sum(dataflow.retry_delay(F.col("attempt"))).alias("seconds"))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("not late")
    own = e.groupBy(F.col("channel").alias("namespace"), F.col("thread").cast("string").alias("key")).agg(F.max("event_id").alias("value"))
    return own.withColumn("expires", F.when(F.col("value") % 3 > 0, F.lit(NOW) + (F.col("value") % 100 - 50).cast("double")))


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _events(spark, sf_dir).select(F.col("channel").alias("namespace"), F.col("thread").cast("string").alias("key")).distinct()
    return dataflow.cache_get(_cache(spark, sf_dir), asked, NOW)


def cache_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One namespace cleared, then late events set, some with a time to live."""
    e = _events(spark, sf_dir).where("late")
    new = e.groupBy(F.col("channel").alias("namespace"), F.col("thread").cast("string").alias("key")).agg(F.max("event_id").alias("value"))
    new = new.withColumn("ttl", F.when(F.col("value") % 8 == 0, F.lit(60.0)))
    return dataflow.cache_set(dataflow.cache_clear(_cache(spark, sf_dir), ("view",)), new, NOW)


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.cache_statistics(cache_lookup(spark, sf_dir))


def put_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(
        F.concat(F.lit("t"), F.col("thread").cast("string")).alias("thread_id"), F.lit("").alias("checkpoint_ns"), F.lit("c1").alias("checkpoint_id"),
        F.col("channel").alias("task_id"), (F.col("event_id") % 4 - 1).alias("idx"), F.col("event_id").alias("blob"), (F.col("event_id") % 2).alias("half"),
    )
    key = ["thread_id", "checkpoint_ns", "checkpoint_id", "task_id", "idx"]
    first = lambda half: e.where(F.col("half") == half).groupBy(*key).agg(F.min("blob").alias("blob"))
    return state.put_writes(first(0), first(1))


def last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return state.last_value(e.select(F.col("event_id").alias("step"), "channel", F.col("event_id").alias("ord"), "value"))


def topic_accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's topic, step by step."""
    e = _events(spark, sf_dir)
    writes = e.select(F.col("thread").alias("channel"), (F.col("event_id") % 4).alias("step"), F.col("event_id").alias("ord"), F.array("value").alias("value"))
    # What a step has are the values below its size: its last three are met by their places.
    sizes = ordered.topic_sizes(writes).withColumn("place", F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - 3), F.col("n") - 1)))
    met = sizes.join(ordered.topic_values(writes, accumulate=True).drop("step"), ["channel", "place"])
    latest = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"].cast("string"))
    return met.groupBy("channel", "step").agg(F.first("n").cast("int").alias("n"), F.array_join(latest, ",").alias("latest"))


def local_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's late events of one type are a task's writes: what each task reads."""
    old, writes = _state_and_writes(spark, sf_dir)
    mine = writes.withColumn("node", F.col("channel"))
    return dataflow.local_reads(old, mine, mine, KINDS)


def command_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commands: clicks go to one node, purchases to two, errors resume, all update."""
    goto = F.when(F.col("event_type") == "click", F.array(F.lit("rank"))).when(F.col("event_type") == "purchase", F.array(F.lit("settle"), F.lit("rank")))
    update = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("user"), F.col("user_id").cast("string"))
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("thread"), goto.alias("goto"), F.when(F.col("event_type") == "error", F.col("user_id")).alias("resume"),
        F.when(F.col("event_type") != "view", update).alias("update"),
    )
    return dataflow.command_writes(e)


QUERIES = {
    f.__name__: f
    for f in (
        step_writes, step_saved, step_after_finish, edge_targets, branch_routes, send_fanout, node_input, interrupt_tasks, resume_pending,
        fork_state, delete_thread, stream_updates, stream_values, retry_delays, cache_lookup, cache_rewrite, cache_hits, put_writes, last_value,
        topic_accumulated, local_read, command_map,
    )
}

_E = f"""e AS (
  SELECT user_id AS thread, event_type AS channel, event_id, event_id % 100 AS value, ts >= TIMESTAMP '{SINCE}' AS late, day(ts) AS day FROM events
)"""
_LATEST = "arg_max(value, event_id) AS value, count(*) AS version"
_OLD = f"""{_E}, old AS (
  SELECT thread, channel, {_LATEST} FROM e WHERE NOT late GROUP BY 1, 2
)"""
_STEP = f"""{_OLD}, new AS (
  SELECT thread, channel, sum(value)::BIGINT AS s, max(value) AS m, arg_max(value, event_id) AS l FROM e WHERE late GROUP BY 1, 2
), top AS (SELECT thread, max(version) AS top FROM old GROUP BY 1), made AS (
  SELECT coalesce(o.thread, n.thread) AS thread, coalesce(o.channel, n.channel) AS channel,
    CASE WHEN n.l IS NULL THEN CASE WHEN o.channel <> 'error' THEN o.value END
      WHEN n.channel = 'click' THEN coalesce(o.value, 0) + s WHEN n.channel = 'purchase' THEN greatest(o.value, m) ELSE l END AS value,
    CASE WHEN n.l IS NULL THEN o.version ELSE coalesce(top, 0) + 1 END AS version
  FROM old o FULL JOIN new n ON o.thread = n.thread AND o.channel = n.channel LEFT JOIN top ON top.thread = coalesce(o.thread, n.thread)
)"""
_LOG = f"""{_E}, log AS (
  SELECT thread % 20 AS thread, event_id // 500 AS step, channel, max(event_id) % 3 AS value FROM e GROUP BY 1, 2, 3
)"""
_CACHE = f"""{_E}, stored AS (
  SELECT channel AS namespace, thread::VARCHAR AS key, max(event_id) AS value FROM e WHERE NOT late GROUP BY 1, 2
), cache AS (SELECT *, CASE WHEN value % 3 > 0 THEN {NOW} + (value % 100 - 50)::DOUBLE END AS expires FROM stored)"""
_LOOKUP = f"""{_CACHE}, live AS (SELECT * FROM cache WHERE expires IS NULL OR {NOW} < expires),
looked AS (
  SELECT a.namespace, a.key, l.value, l.value IS NOT NULL AS hit FROM (SELECT DISTINCT channel AS namespace, thread::VARCHAR AS key FROM e) a
  LEFT JOIN live l ON a.namespace = l.namespace AND a.key = l.key
)"""

SQL = {
    "step_writes": f"WITH {_STEP} SELECT * FROM made",
    "step_saved": f"WITH {_STEP} SELECT * FROM made WHERE channel <> 'signup' AND value IS NOT NULL",
    "step_after_finish": f"""WITH {_E} SELECT thread, channel, arg_max(value, event_id) AS value FROM e
WHERE thread IN (SELECT thread FROM e WHERE channel = 'purchase' AND value > 80) GROUP BY 1, 2""",
    "edge_targets": f"""WITH {_E}, done AS (SELECT DISTINCT thread * 100 + day AS thread, channel AS node FROM e),
edges AS (SELECT * FROM ({EDGES}) AS t(source, target)), waiting AS (SELECT * FROM ({WAITING}) AS t(source, target))
SELECT thread, target AS node FROM done JOIN edges ON node = source UNION
SELECT thread, target FROM done JOIN waiting w ON node = source GROUP BY thread, target HAVING count(*) = (SELECT count(*) FROM waiting x WHERE x.target = w.target)""",
    "branch_routes": f"""WITH {_E}, old AS (SELECT thread, channel, {_LATEST} FROM e GROUP BY 1, 2) SELECT channel, CASE WHEN value >= 90 THEN 'review' WHEN channel = 'error' AND value > 10 THEN 'repair' ELSE 'end' END AS node,
  count(*) AS n, sum(value)::BIGINT AS total FROM old GROUP BY 1, 2""",
    "send_fanout": f"""WITH {_E}, s AS (SELECT event_id AS thread, event_id % 20 AS step, unnest(range(1, value % 3 + 2)) AS input FROM e)
SELECT thread, step, (input - 1)::INT AS place, input, substr(sha256(thread || '|' || step || '|worker|' || (input - 1)), 1, 16) AS task_id FROM s""",
    "node_input": f"""WITH {_E}, reads AS (SELECT * FROM ({READS}) AS t(node, channel, needed)),
filled AS (SELECT thread * 100 + day AS thread, channel, {_LATEST} FROM e GROUP BY 1, 2),
asked AS (SELECT t.thread, node, r.channel, needed, value FROM (SELECT DISTINCT thread FROM filled) t CROSS JOIN reads r
  LEFT JOIN filled f ON f.thread = t.thread AND f.channel = r.channel)
SELECT thread, node, string_agg(channel || '=' || value, ',' ORDER BY channel) FILTER (value IS NOT NULL) AS input FROM asked
GROUP BY 1, 2 HAVING bool_and(NOT needed OR value IS NOT NULL) AND count(value) > 0""",
    "interrupt_tasks": f"""WITH {_E}, v AS (SELECT thread, max(event_id) AS version FROM e WHERE channel = 'error' GROUP BY 1),
s AS (SELECT thread, max(event_id) AS seen FROM e WHERE channel = 'error' AND NOT late GROUP BY 1)
SELECT DISTINCT thread, channel AS node FROM e WHERE channel IN ('purchase', 'signup')
  AND thread IN (SELECT v.thread FROM v LEFT JOIN s USING (thread) WHERE version > coalesce(seen, 0))""",
    "resume_pending": f"""WITH {_E}, p AS (SELECT DISTINCT thread, channel FROM e WHERE late), c AS (SELECT DISTINCT channel FROM e),
t AS (SELECT channel, count(*) AS to_run FROM (SELECT DISTINCT thread, channel FROM e EXCEPT SELECT * FROM p) GROUP BY 1),
r AS (SELECT channel, count(*) AS replayed, sum(value)::BIGINT AS total FROM e WHERE late GROUP BY 1)
SELECT channel, coalesce(to_run, 0) AS to_run, coalesce(replayed, 0) AS replayed, coalesce(total, 0) AS total
FROM c LEFT JOIN t USING (channel) LEFT JOIN r USING (channel) WHERE to_run IS NOT NULL OR replayed IS NOT NULL""",
    "fork_state": f"""WITH {_E}, s AS (SELECT thread, event_id // 50 AS checkpoint_id, channel, arg_max(value, event_id) AS value, count(*) AS version FROM e GROUP BY 1, 2, 3),
heads AS (SELECT thread, min(checkpoint_id) AS parent FROM s GROUP BY 1),
old AS (SELECT s.* FROM s JOIN heads ON heads.thread = s.thread AND heads.parent = s.checkpoint_id),
top AS (SELECT thread, max(version) AS top FROM old GROUP BY 1)
SELECT thread, channel, value, version, parent FROM old JOIN heads USING (thread) WHERE channel <> 'click' AND channel <> 'error'
UNION ALL SELECT thread, channel, NULL, version, parent FROM old JOIN heads USING (thread) WHERE channel = 'error'
UNION ALL SELECT thread, 'click', coalesce((SELECT value FROM old o WHERE o.thread = heads.thread AND o.channel = 'click'), 0) + 7, top + 1, parent FROM heads JOIN top USING (thread)""",
    "delete_thread": f"""WITH {_E} SELECT thread, count(*) AS n FROM e
WHERE thread NOT IN (SELECT thread FROM e WHERE channel = 'signup' AND value < 5) GROUP BY 1""",
    "stream_updates": f"""WITH {_LOG} SELECT thread, step, channel, value FROM (
  SELECT *, lag(value) OVER (PARTITION BY thread, channel ORDER BY step) AS before FROM log) WHERE value IS DISTINCT FROM before""",
    "stream_values": f"""WITH {_LOG}, steps AS (SELECT DISTINCT thread, step FROM log)
SELECT s.thread, s.step, l.channel, arg_max(l.value, l.step) AS value FROM steps s JOIN log l ON l.thread = s.thread AND l.step <= s.step GROUP BY 1, 2, 3""",
    "retry_delays": f"""WITH {_E} SELECT event_id, sum(least(128.0, 0.5 * 2 ** (a - 1)))::DOUBLE AS seconds
FROM (SELECT event_id, unnest(range(1, value % 10 + 2)) AS a FROM e WHERE channel = 'error') GROUP BY 1""",
    "cache_lookup": f"WITH {_LOOKUP} SELECT * FROM looked",
    "cache_hits": f"WITH {_LOOKUP} SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 4) AS hit_rate FROM looked",
    "cache_rewrite": f"""WITH {_CACHE}, new AS (
  SELECT channel AS namespace, thread::VARCHAR AS key, max(event_id) AS value FROM e WHERE late GROUP BY 1, 2
) SELECT namespace, key, value, CASE WHEN value % 8 = 0 THEN {NOW} + 60.0::DOUBLE END AS expires FROM new UNION ALL
SELECT namespace, key, value, expires FROM cache WHERE namespace <> 'view' AND (expires IS NULL OR {NOW} < expires)
  AND (namespace, key) NOT IN (SELECT (namespace, key) FROM new)""",
    "put_writes": f"""WITH {_E}, w AS (SELECT 't' || thread AS thread_id, '' AS checkpoint_ns, 'c1' AS checkpoint_id, channel AS task_id, event_id % 4 - 1 AS idx, event_id AS blob FROM e)
SELECT thread_id, checkpoint_ns, checkpoint_id, task_id, idx,
  CASE WHEN idx < 0 THEN coalesce(min(blob) FILTER (blob % 2 = 1), min(blob)) ELSE coalesce(min(blob) FILTER (blob % 2 = 0), min(blob)) END AS blob
FROM w GROUP BY 1, 2, 3, 4, 5""",
    "last_value": f"WITH {_E} SELECT event_id AS step, channel, value FROM e",
    "topic_accumulated": f"""WITH {_E}, s AS (SELECT DISTINCT thread AS channel, event_id % 4 AS step FROM e), w AS (
  SELECT s.channel, s.step, e.value, row_number() OVER (PARTITION BY s.channel, s.step ORDER BY event_id % 4 DESC, event_id DESC) AS r,
    event_id % 4 AS own, event_id FROM s JOIN e ON e.thread = s.channel AND e.event_id % 4 <= s.step
) SELECT channel, step, count(*)::INT AS n, string_agg(value::VARCHAR, ',' ORDER BY own, event_id) FILTER (r <= 3) AS latest FROM w GROUP BY 1, 2""",
    "local_read": f"""WITH {_STEP}, t AS (SELECT DISTINCT thread, channel AS node FROM e WHERE late),
seen AS (SELECT t.thread, node, channel, value FROM t JOIN old USING (thread))
SELECT coalesce(seen.thread, new.thread) AS thread, coalesce(node, new.channel) AS node, coalesce(seen.channel, new.channel) AS channel,
  CASE WHEN l IS NULL THEN value WHEN new.channel = 'click' THEN coalesce(value, 0) + s WHEN new.channel = 'purchase' THEN greatest(value, m) ELSE l END AS value
FROM seen FULL JOIN new ON new.thread = seen.thread AND new.channel = seen.channel AND new.channel = seen.node""",
    "command_map": """WITH c AS (SELECT event_id AS thread, event_type AS t, user_id::VARCHAR AS u, json_extract_string(props, '$.k') AS k FROM events),
g AS (SELECT thread, u, k, t, CASE t WHEN 'click' THEN ['rank'] WHEN 'purchase' THEN ['settle', 'rank'] ELSE [] END AS goto FROM c),
n AS (SELECT *, len(goto) + (t = 'error')::INT AS before FROM g)
SELECT thread, (i - 1)::INT AS path, 'branch:to:' || goto[i] AS channel, '__start__' AS value FROM (SELECT *, unnest(range(1, len(goto) + 1)) AS i FROM n)
UNION ALL SELECT thread, 0, '__resume__', u FROM n WHERE t = 'error'
UNION ALL SELECT thread, before, 'k', k FROM n WHERE t <> 'view' UNION ALL SELECT thread, before + 1, 'user', u FROM n WHERE t <> 'view'""",
}
