"""The item store on disk: hashed buckets as folders, of which a batch of writes rewrites only those it touches.

An item lies in the folder of a hash of its namespace and key.  A batch reads the buckets of its own keys,
applies :func:`loomery.operators.store.upsert` (or a sweep, or a refresh) to them and puts
them back by dynamic partition overwrite; the other folders' files stay as they are.  Batches have
ids, kept beside the items: one that was applied is not applied again.  A batch that broke off before its id was
written can be repeated with the same ``now``: writing an item twice gives the same item.

Defined results: a bucket that a batch empties keeps a file without items; an empty batch rewrites
nothing; a key that a batch writes several times gets its last write.  There is one writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.lineage import cut
from loomery.operators import store

SCHEMA = (
    "namespace array<string>, key string, value string, created_at timestamp, updated_at timestamp, expires_at timestamp, ttl_minutes double"
)


@dataclass
class BucketStore:
    path: str
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("namespace", "key"), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())  # a number a bucket at most

    def items(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The items of some buckets, or all; other folders are not opened."""
        rows = spark.read.schema(f"{SCHEMA}, bucket int").parquet(f"{self.path}/items")
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return rows.where("key is not null").drop("bucket")

    def _put(self, rows: DataFrame, buckets: list[int], mode: str = "overwrite") -> None:
        spark = rows.sparkSession
        # A bucket without items is overwritten too.
        marks = spark.createDataFrame([(b,) for b in buckets], "bucket int")
        blank = marks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], SCHEMA).schema], "bucket")
        own = rows.select(*[f.name for f in spark.createDataFrame([], SCHEMA).schema]).withColumn("bucket", self._bucket()).unionByName(blank)
        writer = own.hint("rebalance", "bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket")
        writer.parquet(f"{self.path}/items")

    def create(self, items: DataFrame) -> None:
        """A new store of these items; its folder must not be there."""
        self._put(items, list(range(self.buckets)), "error")

    def _seen(self, spark: SparkSession, batch_id: str) -> bool:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches/{batch_id}/_SUCCESS")
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)

    def _note(self, spark: SparkSession, batch_id: str, buckets: list[int]) -> None:
        spark.createDataFrame([(b,) for b in buckets], "bucket int").coalesce(1).write.mode("overwrite").json(f"{self.path}/batches/{batch_id}")

    def apply(self, batch: DataFrame, now: Column, batch_id: str) -> list[int]:
        """Upsert a batch (ord, namespace, key, value or null to delete, ttl_minutes); the buckets it rewrote."""
        spark = batch.sparkSession
        if self._seen(spark, batch_id):
            return []
        touched = self._touched(batch)
        if touched:
            self._put(cut(store.upsert(self.items(spark, touched), batch, now)), touched)
        self._note(spark, batch_id, touched)
        return touched

    def sweep(self, spark: SparkSession, now: Column) -> list[int]:
        """Remove expired items; only buckets that hold one are rewritten."""
        touched = self._touched(self.items(spark).where(F.col("expires_at") < now))
        if touched:
            self._put(cut(store.sweep(self.items(spark, touched), now)), touched)
        return touched

    def refresh(self, hits: DataFrame, now: Column) -> list[int]:
        """Set the expiry of read items (namespace, key) with a ttl anew."""
        spark = hits.sparkSession
        found = self.items(spark, self._touched(hits)).where("ttl_minutes is not null").join(hits.select("namespace", "key").distinct(), ["namespace", "key"], "left_semi")
        touched = self._touched(found)
        if touched:
            self._put(cut(store.refresh(self.items(spark, touched), hits, now)), touched)
        return touched

    def get(self, requests: DataFrame) -> DataFrame:
        """Answers to requests (ord, namespace, key) out of their buckets, absent ones with nulls."""
        return store.get_items(self.items(requests.sparkSession, self._touched(requests)), requests)
