"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen & Thorup, 2017): in round ``i`` every shingle is thrown into a
hashed bin with value ``i`` + a hashed fraction, and a bin keeps its least value.  After
``t`` such rounds, round ``t + b`` throws every shingle into bin ``b``, so each of the
``t`` coordinates fills whatever the set's size; most sets fill in the first rounds.  Two
sets agree in a coordinate with a probability equal to their Jaccard similarity.

Links are decided on full shingle sets.  Documents with equal sets are one class before
banding.  Inside a bucket of the banding no list of pairs is made: first every class is
checked against the bucket's smallest one; then buckets of three or more classes that
still hold several components are searched for links between components, by counting
shared shingles over an inverted list of the bucket (one block of it, where it is large).
As a pair inside one component cannot change the components, the result is that of
checking every pair of every bucket, with no cap anywhere.

With 128 coordinates in 32 bands of 4, a pair at exactly 0.75 misses every band with a
probability of 5e-6; pairs above it with less.

Defined results: documents without words (null, empty or blank texts) have an empty set,
size 0, and are their own component; documents with fewer words than a shingle have one;
rows with a null id are kept, never linked, and have a null component.  A repeated id is
one vertex.  Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import flat
from loomery.llm.components import components
from loomery.llm.util import cut, map_batches

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def fast_similarity_sketch(values: np.ndarray, edge: np.ndarray, size: int) -> np.ndarray:
    """Sketches of the sets ``values[edge[i]:edge[i + 1]]``: one row of ``size`` coordinates each.

    ``size`` is a power of two.  An empty set's row stays all ones.
    """
    n = len(edge) - 1
    out = np.full((n, size), _EMPTY, dtype=np.uint64)
    cells = out.ravel()
    counts = np.diff(edge)
    owner = np.repeat(np.arange(n), counts)
    live = counts > 0
    seeds = flat.mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in range(2 * size):
        if not len(values):
            break
        h = flat.mix(values ^ seeds[i])
        low = (np.uint64(i) << np.uint64(55)) | (h >> np.uint64(9))
        if i < size:
            where = owner * size + (h & np.uint64(size - 1)).astype(np.int64)
            np.minimum.at(cells, where, low)
        else:
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            own = owner[first]
            least = np.minimum.reduceat(low, first)
            out[own, i - size] = np.minimum(out[own, i - size], least)
        full = (out != _EMPTY).all(axis=1)
        if (still := live & ~full).sum() < live.sum():
            live = still
            keep = live[owner]
            values, owner = values[keep], owner[keep]
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates; the band is part of the key."""
    n, size = sketch.shape
    bands = size // rows
    parts = sketch[:, : bands * rows].reshape(n, bands, rows)
    key = (parts * flat.PLACES[:rows]).sum(axis=2, dtype=np.uint64)
    return flat.mix(key + np.arange(1, bands + 1, dtype=np.uint64) * flat.PLACES[61])


def _sketches(docs: DataFrame, width: int, size: int, rows: int) -> DataFrame:
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            count, one, two, keys = [], [], [], []
            for chunk in flat.chunks(batch.column(1)):
                values, edge = flat.shingle_sets(chunk, width)
                sets = np.diff(edge)
                some = np.flatnonzero(sets)
                sums = np.zeros((2, chunk.n), dtype=np.uint64)
                if len(some):
                    sums[0, some] = np.add.reduceat(flat.mix(values), edge[some])
                    sums[1, some] = np.add.reduceat(flat.mix(values ^ flat.PLACES[60]), edge[some])
                count.append(sets)
                one.append(sums[0])
                two.append(sums[1])
                keys.append(band_keys(fast_similarity_sketch(values, edge, size), rows))
            keys = np.concatenate(keys)
            at = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
            return pa.record_batch(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(np.concatenate(count).astype(np.int64)),
                    pa.array(np.concatenate(one).view(np.int64)),
                    pa.array(np.concatenate(two).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel().view(np.int64))),
                ],
                names=["id", "n", "d1", "d2", "keys"],
            )

        return each

    return map_batches(docs, make, "id long, n long, d1 long, d2 long, keys array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, own): the full shingle set as sorted 64-bit hashes."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = []
            for chunk in flat.chunks(batch.column(1)):
                values, edge = flat.shingle_sets(chunk, width)
                own += [values[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            return pa.record_batch([batch.column(0), pa.array(own, pa.binary())], names=["id", "own"])

        return each

    return map_batches(docs, make, "id long, own binary")


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets have 100 * intersection >= percent * union."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x = np.frombuffer(a.as_buffer(), dtype=np.uint64)
                y = np.frombuffer(b.as_buffer(), dtype=np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            return batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

        return each

    return map_batches(pairs, make, "u long, v long")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    ends = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    own = _sets(docs.join(ends, "id", "left_semi"), width)
    both = (
        pairs.join(own.select(F.col("id").alias("u"), F.col("own").alias("a")), "u")
        .join(own.select(F.col("id").alias("v"), F.col("own").alias("b")), "v")
        .select("u", "v", "a", "b")
    )
    return _linked(both, percent)


def links_between(
    component: np.ndarray, block: np.ndarray, sets: list[np.ndarray], percent: int, across: bool
) -> list[tuple[int, int]]:
    """Links (positions) between sets of different components; one for each set and other component.

    ``across``: only between different blocks.  Counts shared elements over an inverted list.
    """
    size = np.array([len(x) for x in sets])
    flat_, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, element = np.unique(flat_, return_inverse=True)
    order = np.argsort(element, kind="stable")
    posted = doc[order]
    count = np.bincount(element)
    begin = np.cumsum(count) - count
    edge = np.r_[0, np.cumsum(size)]
    kinds, first, number = np.unique(component, return_index=True, return_counts=True)
    largest = kinds[number.argmax()]
    found = []
    for x in np.flatnonzero(component != largest).tolist():
        own = element[edge[x] : edge[x + 1]]
        n = count[own]
        at = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(posted[at], minlength=len(sets))
        ok = (100 * shared >= percent * (size + size[x] - shared)) & (component != component[x])
        if across:
            ok &= block != block[x]
        hits = np.flatnonzero(ok)
        if len(hits):
            found += [(x, int(hits[i])) for i in np.unique(component[hits], return_index=True)[1]]
    return found


def _across(units: DataFrame, percent: int) -> DataFrame:
    """Links inside each unit (key, p, q); ``units`` lies in partitions sorted by these."""

    def run(batches):
        held_key, held = None, []

        def settle():
            if len(held) < 2:
                return []
            rep, component, block = (np.array([h[i] for h in held], dtype=np.int64) for i in range(3))
            sets = [np.frombuffer(h[3], dtype=np.uint64) for h in held]
            return [(rep[i], rep[j]) for i, j in links_between(component, block, sets, percent, held_key[1] != held_key[2])]

        def out(found):
            u, v = zip(*found)
            return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for key, p, q, *row in zip(*columns):
                if (key, p, q) != held_key:
                    if found := settle():
                        yield out(found)
                    held_key, held = (key, p, q), []
                held.append(row)
        if found := settle():
            yield out(found)

    return units.mapInArrow(run, "u long, v long")


def _links_across(members: DataFrame, docs: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Links between components that meet in a bucket of three or more; ``members``: key, rep, n, component.

    A bucket with more than ``block`` shingles is dealt into blocks of about that many, and
    each two blocks meet in a unit of their own.
    """
    mixed = (
        members.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"),
            F.min("component").alias("a"), F.max("component").alias("b"),
        )
        .where("m > 2 and a < b")
        .select("key", F.ceil(F.col("total") / block).cast("int").alias("blocks"))
    )
    dealt = members.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("long"))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    units = cut(
        units.select(
            "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
            F.col("rep").alias("id"), "component", "block",
        )
    )
    own = _sets(docs.join(units.select("id").distinct(), "id", "left_semi"), width)
    full = units.join(own, "id").select("key", "p", "q", "id", "component", "block", "own")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _across(full.repartition(parts, "key", "p", "q").sortWithinPartitions("key", "p", "q"), percent)


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 75,
    size: int = 128,
    rows: int = 4,
    block: int = 200_000,
) -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept (see the module's head)."""
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketches = cut(_sketches(texts, width, size, rows))
    named = sketches.where("n > 0 and id is not null")
    classes = named.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"))
    buckets = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last")
    crowd = cut(buckets.join(shared.select("key", "hub"), "key"))
    texts = texts.where("id is not null")

    first = cut(crowd.where("rep <> hub").select(F.col("hub").alias("u"), F.col("rep").alias("v")).distinct())
    links = cut(_verified(first, texts, width, percent))
    found = components(links)

    members = cut(
        crowd.join(found.withColumnRenamed("vertex", "rep"), "rep", "left").select(
            "key", "rep", "n", F.coalesce("component", "rep").alias("component")
        )
    )
    more = _links_across(members, texts, width, percent, block)

    copies = (
        named.select("id", "d1", "d2", "n")
        .join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"])
        .where("id <> rep")
        .select(F.col("id").alias("u"), F.col("rep").alias("v"))
    )
    final = components(links.unionByName(more).unionByName(copies))
    return (
        sketches.select("id", "n")
        .join(final.withColumnRenamed("vertex", "id"), "id", "left")
        .select(
            F.col("id").alias(key),
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )
