"""Structured Streaming over event tables: windows, sessions, idle users, joins of streams, and sinks that survive a restart.

An extension: the capabilities are Spark's, with watermarks bounding the state.  Results are
parquet tables in the shared folder, never tables of the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery import lineage

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, directory: str, glob: str = "*.parquet", per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SCHEMA).option("pathGlobFilter", glob)
    rows = (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(directory)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    own = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return own.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(
        F.unix_micros("window.start").alias("start_us"), "event_type", "events", "total"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    own = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return own.agg(F.count(F.lit(1)).alias("events")).select("user_id", F.unix_micros("w.start").alias("first_us"), "events")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def idle_sessions(events: DataFrame, idle_ms: int = 30 * 60_000, late: str = "10 minutes") -> DataFrame:
    """(user_id, first_ms, last_ms, events) of sessions that ended by ``idle_ms`` without an event; each is given out when the
    watermark passes that time, so the last ones wait for later events.

    Events may come in any order above the watermark, and so may join two sessions.  A user's state is three numbers an
    open session, kept by Spark's session windows: no call to Python an event or a user.
    """
    # Times are whole milliseconds, so half a one more takes in an event that is idle_ms later, and none of the next one.
    gap = f"{idle_ms * 1000 + 500} microseconds"
    rows = events.select("user_id", F.timestamp_millis(F.unix_millis("ts")).alias("ts")).withWatermark("ts", late)
    own = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    made = own.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("events"))
    return made.select("user_id", F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"), "events")


def joined(events: DataFrame, left: str = "click", right: str = "purchase", within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(user_id, left_id, right_id) of a user's events of two types, the second within a time after the first; a join of two streams.

    Both watermarks and the bound on time let Spark drop what can match no more.
    """
    a = events.where(F.col("event_type") == left).select(F.col("user_id").alias("u"), F.col("event_id").alias("left_id"), F.col("ts").alias("at")).withWatermark("at", late)
    b = events.where(F.col("event_type") == right).select("user_id", F.col("event_id").alias("right_id"), "ts").withWatermark("ts", late)
    return a.join(b, F.expr(f"u = user_id AND ts >= at AND ts <= at + INTERVAL {within}")).select("user_id", "left_id", "right_id")


def run_available(stream: DataFrame, output: str = "append", path: str | None = None, name: str | None = None) -> DataFrame:
    """Run a stream over what is there; its result as a parquet table in the shared folder.

    Each batch is a folder of its own number, overwritten if the batch is run again, so a restart (the same
    ``path``) neither loses rows nor doubles them.  In mode ``complete`` the last batch is the whole result.
    """
    spark = stream.sparkSession
    path = path or f"{lineage.shared_folder(spark)}/streams/{name or uuid.uuid4().hex}"
    schema = stream.schema

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    # State on disk, so that many open sessions need no heap; a running query keeps the store it began with.
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.foreachBatch(put).outputMode(output).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    query.awaitTermination()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/rows/batch=-1")  # readable where no batch came
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, batch int").parquet(f"{path}/rows")
    if output == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == (-1 if last is None else last))
    return rows.drop("batch")
