"""Store, chat-window and superstep-state queries over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.functions import vectors
from loomery.lineage import shared_folder
from loomery.operators import bucket_store, chat, ordered, state, store
from loomery.plans.common import table

NOW = "2024-01-15 00:00:00"


def _props_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items: user and type as namespace, the event id as key; every third has a ttl."""
    e = table(spark, sf_dir, "events")
    ttl = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("double"))
    ts = F.col("ts").cast("timestamp_ntz").cast("timestamp")
    return e.select(
        F.array(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_type")).alias("namespace"),
        F.col("event_id").cast("string").alias("key"), F.col("props").alias("value"),
        ts.alias("created_at"), ts.alias("updated_at"), store.expiry(ts, ttl).alias("expires_at"), ttl.alias("ttl_minutes"),
    )


def namespace_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many namespaces lie under each prefix of one."""
    made = store.namespace_counts(_props_items(spark, sf_dir))
    return made.select(F.array_join("prefix", ".").alias("prefix"), "n")


def item_filter_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _props_items(spark, sf_dir)
    specs = {
        "eq": {"k": 50}, "ne": {"k": {"$ne": 50}}, "gt": {"k": {"$gt": 50}}, "gte": {"k": {"$gte": 50}},
        "lt": {"k": {"$lt": 50}}, "lte": {"k": {"$lte": 50}}, "range": {"k": {"$gt": 10, "$lte": 20}}, "missing": {"absent": None},
    }
    return items.agg(*[F.count_if(store.item_filter(s)).alias(n) for n, s in specs.items()])


def item_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = store.search(_props_items(spark, sf_dir), ("u8",), {"k": {"$gte": 20}}, limit=10, offset=5)
    return page.select(F.array_join("namespace", ".").alias("namespace"), "key", "value")


def item_upsert_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first half of events as the store, the second half as one batch: last write by event id."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz").cast("timestamp"))
    ns, key = F.array(F.col("event_type")).alias("namespace"), F.col("user_id").cast("string").alias("key")
    half = e.where("event_id % 2 = 0")
    first = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id"))
    items = half.withColumn("r", first).where("r = 1").select(
        ns, key, F.col("props").alias("value"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
        F.lit(None).cast("timestamp").alias("expires_at"), F.lit(None).cast("double").alias("ttl_minutes"),
    )
    gone = F.when(F.col("event_id") % 7 == 1, None).otherwise(F.col("props"))
    batch = e.where("event_id % 2 = 1").select(
        F.col("event_id").alias("ord"), ns, key, gone.alias("value"), F.lit(None).cast("double").alias("ttl_minutes")
    )
    now = F.lit(NOW).cast("timestamp")
    made = store.upsert(items, batch, now)
    return made.select(
        F.array_join("namespace", ".").alias("namespace"), "key", "value",
        F.unix_micros("created_at").alias("created_us"), (F.col("updated_at") == now).alias("written"),
    )


def item_store_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a store on disk: a third as its first items, the others as two batches of writes, then a sweep."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz").cast("timestamp"))
    ns, key = F.array(F.col("event_type")).alias("namespace"), F.col("user_id").cast("string").alias("key")
    minutes = F.when(F.col("event_id") % 5 == 0, F.lit(600.0))
    first = e.where("event_id % 3 = 0").groupBy("event_type", "user_id").agg(F.min_by(F.struct("props", "ts"), "event_id").alias("r"))
    none = F.lit(None)
    items = first.select(
        ns, key, F.col("r.props").alias("value"), F.col("r.ts").alias("created_at"), F.col("r.ts").alias("updated_at"),
        none.cast("timestamp").alias("expires_at"), none.cast("double").alias("ttl_minutes"),
    )
    own = bucket_store.BucketStore(f"{shared_folder(spark)}/loomery-items-{uuid.uuid4().hex}")
    own.create(items)
    for part, day in ((1, 20), (2, 21)):
        gone = F.when(F.col("event_id") % 7 != 1, F.col("props"))
        batch = e.where(F.col("event_id") % 3 == part).select(F.col("event_id").alias("ord"), ns, key, gone.alias("value"), minutes.alias("ttl_minutes"))
        own.apply(batch, F.lit(f"2024-01-{day} 00:00:00").cast("timestamp"), f"batch{part}")
    own.sweep(spark, F.lit("2024-01-20 12:00:00").cast("timestamp"))
    return own.items(spark).select(F.array_join("namespace", ".").alias("namespace"), "key", "value", F.unix_micros("created_at").alias("created_us"), F.unix_micros("expires_at").alias("expires_us"))


def item_ttl_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = store.sweep(_props_items(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return left.agg(F.count(F.lit(1)).alias("n_left"), F.count("expires_at").alias("with_ttl"))


def item_ttl_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _props_items(spark, sf_dir)
    hits = store.search(items, ("u8", "click"), limit=50)
    made = store.refresh(items, hits, F.lit(NOW).cast("timestamp"))
    return made.where("namespace[0] = 'u8' and expires_at is not null").select(
        "key", F.unix_micros("expires_at").alias("expires_us")
    )


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as items under region, nation and market segment."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    named = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return named.select(F.array("r_name", "n_name", "c_mktsegment").alias("namespace"), F.col("c_custkey").cast("string").alias("key"))


def _joined(namespaces: DataFrame) -> DataFrame:
    return namespaces.select(F.array_join("namespace", ".").alias("namespace"))


def namespace_list_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(store.list_namespaces(_geo(spark, sf_dir), max_depth=2))


def namespace_match_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(store.list_namespaces(_geo(spark, sf_dir), prefix=("*", "NATION_3"), suffix=("*", "BUILDING")))


def item_batch_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in order, one of them for an absent key."""
    ids = spark.range(0, 40).select(
        F.col("id").alias("ord"), F.array(F.concat(F.lit("u"), (F.col("id") % 10).cast("string")), F.lit("click")).alias("namespace"),
        (F.col("id") * 3).cast("string").alias("key"),
    )
    return store.get_items(_props_items(spark, sf_dir), ids).select("ord", "key", "value")


QUERY_VECTOR = [1.0 if i % 2 == 0 else -0.5 for i in range(64)]


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings as up to four vectors of each of a quarter as many items."""
    e = table(spark, sf_dir, "embeddings")
    ns, key = F.array(F.lit("v"), F.col("label").cast("string")), F.floor(F.col("vec_id") / 4).cast("string")
    rows = e.select(ns.alias("namespace"), key.alias("key"), F.col("vec_id").cast("string").alias("path"), "embedding")
    return rows.select("namespace", "key").distinct(), rows


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = F.array(*map(F.lit, QUERY_VECTOR))
    scored = e.select("vec_id", F.round(vectors.cosine(F.col("embedding"), asked), 4).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(20)


def vector_maxpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, rows = _vectors(spark, sf_dir)
    page = store.vector_search(items, rows, QUERY_VECTOR, limit=15)
    return page.select(F.array_join("namespace", ".").alias("namespace"), "key", F.round("score", 4).alias("score"))


def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = F.array(*map(F.lit, QUERY_VECTOR))
    return e.select(
        "vec_id",
        *[F.round(vectors.similarity(k, F.col("embedding"), asked), 5).alias(k) for k in ("cosine", "inner_product", "l2")],
    )


def distinct_on_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's dearest line, ties by line number."""
    rows = table(spark, sf_dir, "lineitem")
    best = rows.groupBy("l_orderkey").agg(F.max(F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("b"))
    return best.select("l_orderkey", F.col("b")["l_extendedprice"].alias("price"), (-F.col("b")["col2"]).alias("l_linenumber"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.withColumn("tokens", F.greatest(F.lit(50), F.floor(F.length("text") / 3).cast("int")))


def evict_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.evict_until(_turns(spark, sf_dir), F.lit(120)).select("conv_id", "turn", "role", "tokens")


def keep_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.keep_last(_turns(spark, sf_dir), 3).select("conv_id", "turn", "role")


def reverse_until_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recent_until(_turns(spark, sf_dir), 2, skip="system").select("conv_id", "turn", "role")


def input_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.split_input(_turns(spark, sf_dir)).select("conv_id", "turn", "role", "part")


def latest_user_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.latest_text(_turns(spark, sf_dir)).select("conv_id", "turn", "text")


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).groupBy("conv_id").pivot("role", ["system", "user", "assistant"]).agg(F.sum("tokens"))


def message_log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a message log: ids repeat by role and parity (replaced in place), late even ids are removed."""
    t = table(spark, sf_dir, "conversations")
    log = t.select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("ord"),
        F.concat(F.col("role"), (F.floor(F.col("turn") / 4) % 2).cast("string")).alias("id"),
        F.lit("add").alias("op"), F.col("text").alias("content"),
    )
    gone = log.where("ord % 3 = 1").select(
        "thread_id", (F.col("ord") + 1000).alias("ord"), "id", F.lit("remove").alias("op"), F.lit(None).cast("string").alias("content")
    )
    return chat.fold_messages(log.unionByName(gone)).select("thread_id", "place", "id", "content")


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") % 20).alias("step"), F.col("event_type").alias("channel"),
        F.col("event_id").alias("ord"), F.col("user_id").alias("value"),
    )


def reducer_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.reduced(_writes(spark, sf_dir), {"total": ("sum", "value"), "last": ("last", "value")})


def reducer_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each channel's sum, highest and first value after every write."""
    made = {"total": ("sum", "value"), "highest": ("max", "value"), "first": ("first", "value")}
    return ordered.running(_writes(spark, sf_dir).select("channel", "ord", "value"), made)


def reducer_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reducer of no known kind, in write order: a channel's sum that starts anew above a bound."""
    return ordered.folded(_writes(spark, sf_dir), 0, lambda a, x: x if a > 100_000 else a + x, "long")


def channel_any_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.any_value(_writes(spark, sf_dir))


def channel_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that each step gave a channel, a row each in their order."""
    return ordered.topic_values(_writes(spark, sf_dir).withColumn("value", F.array("value", F.col("value") + 1)))


def barrier_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _writes(spark, sf_dir).select(F.concat(F.lit("u"), F.col("value").cast("string")).alias("channel"), F.col("channel").alias("value"), "ord")
    return state.barrier_ready(w, ["click", "error", "purchase", "signup", "view"])


def version_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    versions = e.groupBy(F.col("event_type").alias("channel")).agg(F.max("event_id").alias("version"))
    seen = e.groupBy(F.col("user_id").cast("string").alias("node"), F.col("event_type").alias("channel")).agg(F.max("event_id").alias("seen_version"))
    triggers = seen.select("node", "channel")
    return state.due_tasks(triggers, versions, seen.withColumn("seen_version", F.col("seen_version") + 300))


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("thread_id"), F.lit("").alias("checkpoint_ns"),
        F.lpad(F.col("event_id").cast("string"), 10, "0").alias("checkpoint_id"), F.col("event_type").alias("source"), "value",
    )


def checkpoint_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_checkpoints(_checkpoints(spark, sf_dir))


def checkpoint_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.history(_checkpoints(spark, sf_dir), before="0000005000", condition=F.col("source") == "click", limit=25)


def checkpoint_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest checkpoints with the last value of every channel up to them, and the writes of their own id."""
    all_ = _checkpoints(spark, sf_dir)
    key = ["thread_id", "checkpoint_ns"]
    per = all_.groupBy(*key, F.col("source").alias("channel")).agg(F.max("checkpoint_id").alias("version"))
    heads = state.latest_checkpoints(all_).select(*key, "checkpoint_id")
    maps = per.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("channel", "version"))).alias("versions"))
    blobs = all_.select(*key, F.col("source").alias("channel"), F.col("checkpoint_id").alias("version"), F.col("value").cast("string").alias("blob"))
    writes = all_.select(
        *key, "checkpoint_id", F.col("source").alias("task_id"), F.lit(0).alias("idx"),
        F.lit("out").alias("channel"), F.col("value").cast("string").alias("blob"),
    )
    made = state.hydrate(heads.join(maps, key), blobs, writes)
    return made.select(
        "thread_id", "checkpoint_id", F.size("channel_values").alias("n_channels"),
        F.array_join(F.transform("channel_values", lambda v: v["channel"]), ",").alias("channels"),
        F.size("pending_writes").alias("n_writes"),
    )


def staleness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events not older than their risk class allows, at a fixed time."""
    e = table(spark, sf_dir, "events")
    limits = F.create_map(F.lit("view"), F.lit(86400), F.lit("click"), F.lit(3600), F.lit("error"), F.lit(60))
    age = F.lit(1704844800) - F.unix_seconds(F.col("ts").cast("timestamp_ntz").cast("timestamp"))
    return e.where((age >= 0) & (age <= F.try_element_at(limits, F.col("event_type")))).select("event_id", "event_type")


def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user: a pause of more than 30 minutes begins a new one."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp_ntz").cast("timestamp")))
    own = Window.partitionBy("user_id").orderBy("us", "event_id")
    new = F.coalesce((F.col("us") - F.lag("us").over(own) > 1_800_000_000).cast("int"), F.lit(1))
    numbered = e.withColumn("new", new).withColumn("session", F.sum("new").over(own))
    return numbered.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


COMMANDS = "VALUES (1, 'red'), (2, 'small ring'), (3, 'small'), (4, 'blue widget'), (5, 'big')"


def command_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))
    return chat.match_command(inputs, spark.sql(f"SELECT * FROM {COMMANDS} AS t(ord, command)")).drop("text")


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a catalogue: status filter, sort, selected fields, limit and offset, and the full count."""
    found = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'")
    total = found.agg(F.count(F.lit(1)).alias("total"))
    page = found.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(10)
    return page.select("o_orderkey", "o_totalprice").crossJoin(F.broadcast(total))


def ui_message_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as UI messages: every seventh is a full message, the others merge into it; signups remove."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "remove").when(F.col("event_id") % 7 == 0, "add").otherwise("merge")
    log = e.select(
        F.col("user_id").alias("thread_id"), F.col("event_id").alias("ord"), (F.col("event_id") % 3).alias("id"), op.alias("op"),
        F.create_map(F.col("event_type"), F.col("event_id").cast("string")).alias("props"),
    )
    made = chat.merge_ui(log)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return made.select("thread_id", "id", shown.alias("props"))


_LOCAL = (
    command_match, catalog_search, ui_message_merge,
    item_filter_ops, item_search_page, item_upsert_last, item_ttl_sweep, item_ttl_refresh, namespace_list_depth,
    namespace_match_wildcard, item_batch_get, vector_topk, vector_maxpool, vector_distances, distinct_on_best,
    evict_cumsum, keep_last_turns, reverse_until_k, input_split, latest_user_text, token_totals, message_log_fold,
    item_store_batches, namespace_prefixes, reducer_fold, reducer_running, reducer_custom, channel_any_value, channel_topic, barrier_ready, version_triggers, checkpoint_latest,
    checkpoint_history, checkpoint_hydrate, staleness_gate, session_gap,
)
QUERIES = {f.__name__: f for f in _LOCAL}

_ITEMS = f"""
items AS (
  SELECT event_id, 'u' || user_id AS n1, event_type AS n2, event_id::VARCHAR AS key, props AS value, epoch_us(ts) AS us,
    CASE WHEN event_id % 3 = 0 THEN value END AS ttl,
    CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) + floor(value * 60000000)::BIGINT END AS expires_us,
    TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events
), clock AS (SELECT epoch_us(TIMESTAMP '{NOW}') AS now_us)"""
_VECTOR = "[" + ", ".join(map(str, QUERY_VECTOR)) + "]::DOUBLE[]"
_GEO = """
geo AS (
  SELECT r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
_TURNS = "turns AS (SELECT *, greatest(50, length(text) // 3)::INT AS tokens FROM conversations)"

SQL = {
    "command_match": f"""WITH c AS (SELECT * FROM ({COMMANDS}) AS t(ord, command)), m AS (
  SELECT p_partkey, p_name, command, ord FROM part JOIN c ON p_name = command OR starts_with(p_name, command || ' ')
) SELECT p_partkey, arg_min(command, ord) AS command, trim(substr(p_name, length(arg_min(command, ord)) + 1)) AS argument FROM m GROUP BY p_partkey, p_name""",
    "catalog_search": """WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM f) AS total FROM f ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20""",
    "ui_message_merge": """WITH log AS (
  SELECT user_id AS thread_id, event_id AS ord, event_id % 3 AS id, event_type AS key,
    CASE WHEN event_type = 'signup' THEN 'remove' WHEN event_id % 7 = 0 THEN 'add' ELSE 'merge' END AS op FROM events
), own AS (
  SELECT thread_id, id, coalesce(max(ord) FILTER (op = 'add'), -1) AS start, arg_max(op, ord) AS last FROM log GROUP BY 1, 2
), live AS (
  SELECT thread_id, id, key, max(ord) AS ord FROM log JOIN own USING (thread_id, id)
  WHERE ord >= start AND last <> 'remove' AND op <> 'remove' GROUP BY 1, 2, 3
) SELECT thread_id, id, string_agg(key || '=' || ord, ',' ORDER BY key) AS props FROM live GROUP BY 1, 2""",
    "item_filter_ops": f"""WITH {_ITEMS} SELECT count(*) FILTER (k = 50) AS eq, count(*) FILTER (k IS NULL OR k <> 50) AS ne,
  count(*) FILTER (k > 50) AS gt, count(*) FILTER (k >= 50) AS gte, count(*) FILTER (k < 50) AS lt, count(*) FILTER (k <= 50) AS lte,
  count(*) FILTER (k > 10 AND k <= 20) AS range, count(*) FILTER (json_extract_string(value, '$.absent') IS NULL) AS missing FROM items""",
    "item_search_page": f"""WITH {_ITEMS} SELECT n1 || '.' || n2 AS namespace, key, value FROM items
WHERE n1 = 'u8' AND k >= 20 ORDER BY n1, n2, key LIMIT 10 OFFSET 5""",
    "item_upsert_last": """WITH old AS (
  SELECT event_type AS namespace, user_id::VARCHAR AS key, arg_min(props, event_id) AS value, epoch_us(arg_min(ts, event_id)) AS created_us
  FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2
), batch AS (
  SELECT event_type AS namespace, user_id::VARCHAR AS key, max(event_id) AS last FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2
), writes AS (
  SELECT namespace, key, CASE WHEN last % 7 <> 1 THEN props END AS value FROM batch JOIN events ON event_id = last
)
SELECT coalesce(o.namespace, w.namespace) AS namespace, coalesce(o.key, w.key) AS key,
  CASE WHEN w.key IS NULL THEN o.value ELSE w.value END AS value,
  coalesce(o.created_us, epoch_us(TIMESTAMP '""" + NOW + """')) AS created_us, w.key IS NOT NULL AS written
FROM old o FULL JOIN writes w ON o.namespace = w.namespace AND o.key = w.key
WHERE w.key IS NULL OR w.value IS NOT NULL""",
    "item_store_batches": """WITH i0 AS (
  SELECT event_type AS ns, user_id::VARCHAR AS key, arg_min(props, event_id) AS value, epoch_us(arg_min(ts, event_id)) AS created_us, NULL::BIGINT AS expires_us
  FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2
),
s1 AS (SELECT event_type AS ns, user_id::VARCHAR AS key, max(event_id) AS last FROM events WHERE event_id % 3 = 1 GROUP BY 1, 2),
w1 AS (SELECT ns, key, CASE WHEN last % 7 <> 1 THEN props END AS value, CASE WHEN last % 5 = 0 THEN epoch_us(TIMESTAMP '2024-01-20 10:00:00') END AS expires_us FROM s1 JOIN events ON event_id = last),
i1 AS (SELECT coalesce(o.ns, w.ns) AS ns, coalesce(o.key, w.key) AS key, CASE WHEN w.key IS NULL THEN o.value ELSE w.value END AS value,
  coalesce(o.created_us, epoch_us(TIMESTAMP '2024-01-20')) AS created_us, CASE WHEN w.key IS NULL THEN o.expires_us ELSE w.expires_us END AS expires_us
  FROM i0 o FULL JOIN w1 w ON w.ns = o.ns AND w.key = o.key WHERE w.key IS NULL OR w.value IS NOT NULL),
s2 AS (SELECT event_type AS ns, user_id::VARCHAR AS key, max(event_id) AS last FROM events WHERE event_id % 3 = 2 GROUP BY 1, 2),
w2 AS (SELECT ns, key, CASE WHEN last % 7 <> 1 THEN props END AS value, CASE WHEN last % 5 = 0 THEN epoch_us(TIMESTAMP '2024-01-21 10:00:00') END AS expires_us FROM s2 JOIN events ON event_id = last),
i2 AS (SELECT coalesce(o.ns, w.ns) AS ns, coalesce(o.key, w.key) AS key, CASE WHEN w.key IS NULL THEN o.value ELSE w.value END AS value,
  coalesce(o.created_us, epoch_us(TIMESTAMP '2024-01-21')) AS created_us, CASE WHEN w.key IS NULL THEN o.expires_us ELSE w.expires_us END AS expires_us
  FROM i1 o FULL JOIN w2 w ON w.ns = o.ns AND w.key = o.key WHERE w.key IS NULL OR w.value IS NOT NULL)
SELECT ns AS namespace, key, value, created_us, expires_us FROM i2 WHERE expires_us IS NULL OR expires_us >= epoch_us(TIMESTAMP '2024-01-20 12:00:00')""",
    "item_ttl_sweep": f"""WITH {_ITEMS} SELECT count(*) AS n_left, count(expires_us) AS with_ttl
FROM items, clock WHERE expires_us IS NULL OR expires_us >= now_us""",
    "item_ttl_refresh": f"""WITH {_ITEMS}, hits AS (SELECT key FROM items WHERE n1 = 'u8' AND n2 = 'click' ORDER BY key LIMIT 50)
SELECT key, CASE WHEN key IN (SELECT key FROM hits) THEN now_us + floor(ttl * 60000000)::BIGINT ELSE expires_us END AS expires_us
FROM items, clock WHERE n1 = 'u8' AND expires_us IS NOT NULL""",
    "namespace_list_depth": f"WITH {_GEO} SELECT DISTINCT r_name || '.' || n_name AS namespace FROM geo",
    "namespace_match_wildcard": f"""WITH {_GEO} SELECT DISTINCT r_name || '.' || n_name || '.' || c_mktsegment AS namespace
FROM geo WHERE n_name = 'NATION_3' AND c_mktsegment = 'BUILDING'""",
    "item_batch_get": f"""WITH {_ITEMS}, asked AS (SELECT i AS ord, 'u' || (i % 10) AS n1, (i * 3)::VARCHAR AS key FROM range(40) AS t(i))
SELECT ord, a.key, value FROM asked a LEFT JOIN items b ON a.n1 = b.n1 AND b.n2 = 'click' AND a.key = b.key""",
    "vector_topk": f"""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}), 4) AS score
FROM embeddings ORDER BY score DESC, vec_id LIMIT 20""",
    "vector_maxpool": f"""SELECT 'v.' || label AS namespace, (vec_id // 4)::VARCHAR AS key,
  round(max(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR})), 4) AS score
FROM embeddings GROUP BY 1, 2 ORDER BY max(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR})) DESC, 1, 2 LIMIT 15""",
    "vector_distances": f"""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}), 5) AS cosine,
  round(list_inner_product(embedding::DOUBLE[], {_VECTOR}), 5) AS inner_product,
  round(-list_distance(embedding::DOUBLE[], {_VECTOR}), 5) AS l2 FROM embeddings""",
    "distinct_on_best": """SELECT l_orderkey, l_extendedprice AS price, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1""",
    "evict_cumsum": f"""WITH {_TURNS} SELECT conv_id, turn, role, tokens FROM (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM turns) WHERE b >= 120""",
    "keep_last_turns": """SELECT conv_id, turn, role FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3""",
    "reverse_until_k": """SELECT conv_id, turn, role FROM (
  SELECT *, coalesce(count(*) FILTER (role = 'assistant') OVER (
    PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM conversations) WHERE seen < 2 AND role <> 'system'""",
    "input_split": """SELECT conv_id, turn, role, CASE WHEN turn = last THEN 'input' ELSE 'history' END AS part FROM (
  SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE role IN ('user', 'assistant')""",
    "latest_user_text": "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "token_totals": f"""WITH {_TURNS} SELECT conv_id, (sum(tokens) FILTER (role = 'system'))::BIGINT AS system,
  (sum(tokens) FILTER (role = 'user'))::BIGINT AS user, (sum(tokens) FILTER (role = 'assistant'))::BIGINT AS assistant FROM turns GROUP BY 1""",
    "message_log_fold": """WITH log AS (
  SELECT conv_id AS thread_id, turn AS ord, role || ((turn // 4) % 2) AS id, 'add' AS op, text AS content FROM conversations
), everything AS (SELECT * FROM log UNION ALL SELECT thread_id, ord + 1000, id, 'remove', NULL FROM log WHERE ord % 3 = 1)
SELECT thread_id, min(ord) AS place, id, arg_max(content, ord) AS content FROM everything GROUP BY thread_id, id HAVING arg_max(op, ord) = 'add'""",
    "reducer_fold": "SELECT event_type AS channel, sum(user_id)::BIGINT AS total, arg_max(user_id, event_id) AS last FROM events GROUP BY 1",
    "channel_any_value": "SELECT event_id % 20 AS step, event_type AS channel, arg_max(user_id, event_id) AS value FROM events GROUP BY 1, 2",
    "channel_topic": """WITH w AS (SELECT event_type AS channel, event_id % 20 AS step, user_id,
  2 * (row_number() OVER (PARTITION BY event_type, event_id % 20 ORDER BY event_id) - 1) AS base FROM events)
SELECT channel, step, base + i AS place, user_id + i AS value FROM w, (VALUES (0), (1)) AS t(i)""",
    "namespace_prefixes": """WITH n AS (SELECT DISTINCT 'u' || user_id AS a, event_type AS b FROM events)
SELECT a || '.' || b AS prefix, 1::BIGINT AS n FROM n UNION ALL SELECT a, count(*) FROM n GROUP BY a""",
    "reducer_running": """SELECT event_type AS channel, event_id AS ord, user_id AS value, (sum(user_id) OVER o)::BIGINT AS total,
  max(user_id) OVER o AS highest, first(user_id) OVER o AS first FROM events WINDOW o AS (PARTITION BY event_type ORDER BY event_id)""",
    "reducer_custom": """WITH RECURSIVE w AS (SELECT event_type AS channel, user_id AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
f(channel, n, a) AS (SELECT channel, 1::BIGINT, x FROM w WHERE n = 1
  UNION ALL SELECT f.channel, w.n, CASE WHEN a > 100000 THEN x ELSE a + x END FROM f JOIN w ON w.channel = f.channel AND w.n = f.n + 1)
SELECT channel, arg_max(a, n) AS value FROM f GROUP BY 1""",
    "barrier_ready": "SELECT 'u' || user_id AS channel, count(DISTINCT event_type) = 5 AS ready FROM events GROUP BY 1",
    "version_triggers": """WITH v AS (SELECT event_type, max(event_id) AS version FROM events GROUP BY 1),
s AS (SELECT user_id::VARCHAR AS node, event_type, max(event_id) + 300 AS seen FROM events GROUP BY 1, 2)
SELECT DISTINCT node FROM s JOIN v USING (event_type) WHERE version > seen""",
    "checkpoint_latest": """SELECT 't' || user_id AS thread_id, '' AS checkpoint_ns, lpad(max(event_id)::VARCHAR, 10, '0') AS checkpoint_id,
  arg_max(event_type, event_id) AS source, arg_max(value, event_id) AS value FROM events GROUP BY user_id""",
    "checkpoint_history": """SELECT 't' || user_id AS thread_id, '' AS checkpoint_ns, lpad(event_id::VARCHAR, 10, '0') AS checkpoint_id,
  event_type AS source, value FROM events WHERE event_id < 5000 AND event_type = 'click' ORDER BY event_id DESC LIMIT 25""",
    "checkpoint_hydrate": """SELECT 't' || user_id AS thread_id, lpad(max(event_id)::VARCHAR, 10, '0') AS checkpoint_id,
  count(DISTINCT event_type)::INT AS n_channels, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS channels, 1 AS n_writes
FROM events GROUP BY user_id""",
    "staleness_gate": """SELECT event_id, event_type FROM (SELECT *, 1704844800 - epoch_us(ts) // 1000000 AS age FROM events)
WHERE age >= 0 AND age <= CASE event_type WHEN 'view' THEN 86400 WHEN 'click' THEN 3600 WHEN 'error' THEN 60 END""",
    "session_gap": """WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), m AS (
  SELECT *, CASE WHEN us - lag(us) OVER w <= 1800000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)
), n AS (SELECT *, (sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id))::BIGINT AS session FROM m)
SELECT user_id, session, count(*) AS events, min(us) AS first_us, max(us) AS last_us FROM n GROUP BY 1, 2""",
}
