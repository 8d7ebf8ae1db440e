"""The store on disk: which files a batch rewrites, repeated batches, emptied buckets, sweeps and reads."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from loomery.lineage import cut
from loomery.operators import store
from loomery.operators.bucket_store import SCHEMA, BucketStore



def _day(d):
    return F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp")


WRITES = "ord int, namespace array<string>, key string, value string, ttl_minutes double"


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/items/bucket=*/*.parquet")}


@pytest.fixture()
def made(spark, tmp_path):
    rows = [(["a", str(i % 3)], f"k{i}", f"{i}", 60.0 if i % 4 == 0 else None) for i in range(200)]
    frame = spark.createDataFrame(rows, "namespace array<string>, key string, value string, ttl_minutes double")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    items = frame.select("namespace", "key", "value", at.alias("created_at"), at.alias("updated_at"), store.expiry(at, F.col("ttl_minutes")).alias("expires_at"), "ttl_minutes")
    own = BucketStore(str(tmp_path / "store"), 16)
    own.create(items)
    return own, items


def _rows(frame):
    return sorted((r["namespace"], r["key"], r["value"], r["created_at"], r["updated_at"], r["expires_at"]) for r in frame.collect())


def test_a_batch_rewrites_its_own_buckets_only_and_once(spark, made):
    own, items = made
    before = _files(own.path)
    assert len(before) == 16 and _rows(own.items(spark)) == _rows(items)
    batch = spark.createDataFrame([(1, ["a", "0"], "k0", "new", None), (2, ["a", "0"], "k0", "newer", 5.0), (3, ["a", "1"], "k1", None, None), (4, ["z"], "k0", "z", None)], WRITES)
    touched = own.apply(batch, _day(2), "b1")
    after = _files(own.path)
    gone = {f.split("bucket=")[1].split("/")[0] for f in before.keys() - after.keys()}
    assert 1 <= len(touched) <= 3 and gone == set(map(str, touched)) and all(after[f] == t for f, t in before.items() if f in after)
    assert _rows(own.items(spark)) == _rows(store.upsert(items, batch, _day(2)))
    assert own.apply(batch, _day(3), "b1") == [] and _files(own.path) == after
    assert own.apply(batch.limit(0), _day(3), "b2") == [] and _files(own.path) == after
    got = {r["ord"]: r["value"] for r in own.get(spark.createDataFrame([(1, ["a", "0"], "k0"), (2, ["a", "1"], "k1"), (3, ["z"], "k0")], "ord int, namespace array<string>, key string")).collect()}
    assert got == {1: "newer", 2: None, 3: "z"}


def test_a_bucket_can_be_emptied_and_a_broken_batch_repeated(spark, made):
    own, items = made
    every = items.select(F.lit(1).alias("ord"), "namespace", "key", F.lit(None).cast("string").alias("value"), "ttl_minutes")
    assert own.apply(every, _day(2), "all") == list(range(16)) and own.items(spark).count() == 0
    again = spark.createDataFrame([(1, ["a"], "k", "v", None)], WRITES)
    own._put(cut(store.upsert(own.items(spark), again, _day(2))), own._touched(again))  # written, but not noted
    assert own.apply(again, _day(2), "c") and _rows(own.items(spark)) == _rows(store.upsert(spark.createDataFrame([], SCHEMA), again, _day(2)))


def test_sweeps_and_refreshes_touch_buckets_of_their_items(spark, made):
    own, items = made
    hits = items.where("key in ('k4', 'k5')").select("namespace", "key")
    before = _files(own.path)
    assert len(own.refresh(hits, _day(2))) == 1  # k5 has no ttl
    assert len(_files(own.path).keys() & before.keys()) == 15
    want = _rows(store.sweep(store.refresh(items, hits, _day(2)), _day(2)))
    touched = own.sweep(spark, _day(2))
    assert _rows(own.items(spark)) == want and "k4" in {r[1] for r in want} and "k8" not in {r[1] for r in want}
    assert touched and own.sweep(spark, _day(2)) == []
